import random

import pytest

from laneweave.llm.substring import remove_repeated_passages
from laneweave.llm.suffix import remove_repeated_bytes

SCHEMA = "doc_id long, text string, part string, n_words int, `a.b` int"


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(45)]
    rows = []
    for i in range(60):
        t = [r.choice(words) for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            at = r.randint(0, len(t))
            t[at:at] = passage[r.randint(0, 10) : r.randint(30, 45)]
        if i % 10 == 7:
            t = t + t[:40]
        rows.append((i * 3 % 101, r.choice([" ", "\n", "  "]).join(t), "x", 1, 2))
    rows += [(500 + i, rows[5][1], "y", 1, 2) for i in range(4)]
    rows += [(700 + k, " ".join(f"{w}{k}" for w in words[:12] for _ in range(10 * k + 5)), "", 0, 0) for k in range(4)]
    rows += [(710 + p, " ".join(r.choice(words) for _ in range(9)) + " " + " ".join(f"q{p}x{i % p}" for i in range(50)), "", 0, 0) for p in (1, 2, 3, 7, 11)]
    rows += [(600, None, None, None, None), (601, "", "", 0, 0), (None, rows[3][1], "n", 0, 0), (None, rows[6][1], "n", 0, 0), (602, "a " * 300, "", 0, 0), (603, "a " * 200, "", 0, 0), (604, "ab" * 400, "", 0, 0)]
    rows += [rows[8], rows[8]]
    return rows


def order(i):
    return -(1 << 63) if i is None else i


def brute_words(rows, w):
    first = {}
    for i, t, *_ in rows:
        x = (t or "").encode().split()
        for s in range(len(x) - w + 1):
            k = tuple(x[s : s + w])
            first[k] = min(first.get(k, (order(i), s)), (order(i), s))
    out = []
    for i, t, *_ in rows:
        x = (t or "").encode().split()
        gone = set()
        for s in range(len(x) - w + 1):
            if first[tuple(x[s : s + w])] < (order(i), s):
                gone.update(range(s, s + w))
        out.append((i, len(x), len(gone), b" ".join(v for j, v in enumerate(x) if j not in gone).decode()))
    return sorted(out, key=str)


def brute_bytes(rows, w):
    first = {}
    for i, t, *_ in rows:
        x = (t or "").encode()
        for s in range(len(x) - w + 1):
            k = x[s : s + w]
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t, *_ in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - w + 1):
            if first[x[s : s + w]] < order(i):
                gone[s : s + w] = b"\1" * w
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(x), sum(gone), runs, bytes(v for j, v in enumerate(x) if not gone[j])))
    return sorted(out, key=str)


TUNING = [{}, {"hot": 0}, {"piece_units": 31}, {"piece": 7}]  # as it is; all triggers frequent; all texts long; many pieces


@pytest.mark.parametrize("tuning", TUNING)
def test_words_as_brute_force(spark, tuning):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5 if "piece_units" not in tuning else len(rows))
    got = remove_repeated_passages(df, respace=True, **tuning)
    assert got.columns == ["doc_id", "text", "part", "a.b", "n_words", "n_removed"]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=str)
    assert got == brute_words(rows, 20)
    assert sum(g[2] for g in got) > 500


@pytest.mark.parametrize("tuning", TUNING)
def test_bytes_as_brute_force(spark, tuning):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5 if "piece_units" not in tuning else len(rows))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in remove_repeated_bytes(df, **tuning).collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_passages(df).count() == 0
    assert remove_repeated_bytes(df).count() == 0


def test_untouched_text_stays(spark):
    df = spark.createDataFrame([(1, "two  words\n")], "doc_id long, text string")
    assert remove_repeated_passages(df).first().text == "two  words\n"


def test_long_texts_hash_alike():
    import numpy as np

    from laneweave.llm import arrays

    data = np.frombuffer((b"some words of a long text " * 400_000)[: 5 * arrays.SLICE_BYTES // 2 * 2], np.uint8)
    s, e, _ = arrays.word_spans(data, np.array([0, len(data)]), arrays.SPACED)
    assert len(data) > 2 * arrays.SLICE_BYTES
    h = arrays.word_hashes(data, s, e)
    assert len(np.unique(h[:-1])) == 6 and (h[:6] == h[6000:6006]).all()
