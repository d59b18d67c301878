import random
import re

import pytest

from laneweave.llm.contamination import drop_contaminated, find_contamination, hit_words


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return sorted(out, key=str)


def data(seed=1):
    r = random.Random(seed)
    vocab = [f"Wé{i}" if i % 4 == 0 else f"w{i}" for i in range(60)]
    items = [(i, r.choice([" ", ", "]).join(r.choice(vocab) for _ in range(r.choice([1, 3, 6, 9, 10, 11, 25])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, items[3][1]), (3, items[3][1]), (None, "lone item words that nobody has a name for at all"), (103, "...")]
    docs = []
    for d in range(80):
        w = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            t = (r.choice(items)[1] or "").split()
            a = r.randint(0, len(t))
            k = r.randint(0, len(w))
            w[k:k] = t[max(0, a - 12) : a + 3]
        docs.append((d, r.choice([" ", "\n", " - "]).join(w).replace("W", "w")))
    docs += [(None, None), (200, ""), (201, "LONE item-words, that nobody has A name for at all!"), docs[4], docs[4]]
    return docs, items


@pytest.mark.parametrize("block", [4 << 20, 200])
@pytest.mark.parametrize("window", [10, 4])
def test_as_brute_force(spark, window, block):
    docs, items = data()
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, hits string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(df, bench, window=window, block_bytes=block)
    assert out.columns == ["doc_id", "text", "n_words", "hits", "items"]
    got = [(r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in out.withColumn("n", hit_words()).collect()]
    assert sorted(got, key=str) == brute(docs, items, window)
    assert any(g[2] for g in got)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).first().n_words == 2
    assert drop_contaminated(docs, none).count() == 1
    assert find_contamination(docs.limit(0), none).count() == 0
