import random
import re
from collections import Counter, defaultdict

import pytest

from laneweave.llm.divergence import source_divergence, term_counts

SCHEMA = "text string, lang string, source string, value int, rank string"


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(items):
    return [(i, v, r) for r, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1)]


def brute(rows, least, top):
    count, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, source, *_ in rows:
        lang, source, w = lang or "", source or "", terms(t)
        count[lang, source].update(w)
        docs[lang].update(set(w))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        whole = sum((count[lang, s] for s in sources), Counter())
        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            out += [(lang, s, "pair", *x) for x in ranked([(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}])]
            out += [(lang, s, "term", *x) for x in ranked([(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]) if x[2] <= top]
    return sorted(out)


def data(seed=2):
    r = random.Random(seed)
    words = [f"Wört{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)] + ["the", "THE", "日本", "ÀB", "İx"]
    rows = []
    for i in range(300):
        lang = r.choice(["en", "en", "de", None, "", "xx"])
        source = r.choice(["hot"] * 5 + ["a", "b", "ä", None, "", "z"])
        some = words if lang == "en" else words[:: 1 + len(source or "x")]
        rows.append((r.choice([" ", "-", "3\n", "_@[`{"]).join(r.choice(some) for _ in range(r.randint(0, 40))), lang, source, 1, "r"))
    rows += [(None, "en", "nothing", 1, ""), ("", "de", "empty", 1, ""), ("123 !!", "yy", "p", 1, ""), (None, "yy", "q", 1, ""), ("one two", "zz", "only", 1, ""), ("the " * 5000 + "x", "en", "long", 1, "")]
    return rows + [rows[0], rows[0], rows[0]]


@pytest.mark.parametrize("index,top", [(200_000, 200), (40, 7)])
def test_as_brute_force(spark, index, top):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = source_divergence(df, index_rows=index, top=top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(x) for x in out.collect())
    want = brute(rows, 3, top)
    assert got == want and {x[2] for x in want} == {"pair", "term"}
    assert ("yy", "p", "pair", "q", 0, 1) in want


def test_terms_beyond_what_a_task_holds(spark, monkeypatch):
    from laneweave.llm import divergence

    monkeypatch.setattr(divergence, "TERMS_HELD", 50)
    rows = data(seed=9)
    want = Counter()
    for t, lang, source, *_ in rows:
        for x in terms(t):
            want[lang or "", source or "", x] += 1
    batches = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(x.lang, x.source, x.term): x.n for x in term_counts(batches).where("term is not null").collect()}
    assert got == dict(want)


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
