import random

import numpy as np
import pytest
import xxhash

from laneweave.llm.components import components
from laneweave.llm.simhash import drop_near_duplicates, link_group, links, near_duplicate_groups, with_fingerprint

SCHEMA = "doc_id long, text string, fingerprint int, component_id int, part string"


def brute_fingerprint(text, k):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(marks, bits):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(marks):
        for j, (_, b) in enumerate(marks[:i]):
            if (a ^ b).bit_count() <= bits:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [(d, best.get(find(i))) for i, (d, _) in enumerate(marks)]


def rows(seed=5):
    r = random.Random(seed)
    words = [f"Wörd{i}" if i % 5 == 0 else f"word{i}" for i in range(300)]
    out = []
    for i in range(50):
        t = [r.choice(words) for _ in range(r.choice([1, 3, 30, 300, 900]))]
        out.append((1000 - i, " ".join(t), 7, 7, "p"))
        for j in range(r.randint(0, 3)):
            u = list(t)
            for _ in range(j):
                u[r.randrange(len(u))] = r.choice(words)
            out.append((2000 + 10 * i + j, "\t".join(u).upper(), 7, 7, "q"))
    return out + [(1, None, None, None, None), (2, "", 0, 0, ""), (3, " \n", 0, 0, ""), (None, "only one here", 0, 0, ""), out[0], out[0]]


def test_as_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    marks = with_fingerprint(df, keep=["doc_id", "part"])
    want = [(d, brute_fingerprint(t, 4)) for d, t, *_ in data]
    got = [(r.doc_id, r.fingerprint % (1 << 64)) for r in marks.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    groups = [(r.doc_id, r.component_id) for r in near_duplicate_groups(marks).collect()]
    want = brute_groups(want, 4)
    assert sorted(groups, key=str) == sorted(want, key=str)
    assert sum(d != c for d, c in want) > 15


@pytest.mark.parametrize("limit", [60_000, 100])
@pytest.mark.parametrize("bits", [0, 3, 7])
def test_links_connect_what_is_near(spark, bits, limit):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 9))) for b in base for _ in range(20)]
    x = sorted({v & (1 << 64) - 1 for v in base + near})
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) * 2 for v in x], "id long, fp long")
    found = components(links(nodes, bits, limit)).collect()
    got = {(n.node % (1 << 64)): n.root % (1 << 64) for n in found}
    want = brute_groups([(v, v) for v in x], bits)
    by = {}
    for v, c in want:
        by.setdefault(c, set()).add(v)
    mine = {}
    for v in x:
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))


def test_large_group_in_tiles():
    r = np.random.default_rng(1)
    seeds = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique((seeds[r.integers(0, 40, 3000)]) ^ (np.uint64(1) << r.integers(0, 60, 3000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 60, 3000).astype(np.uint64)))
    assert len({int(v) for v in link_group(x[:, None], 4, tile=128)}) == len({int(v) for v in link_group(x[:, None], 4, tile=4096)}) == 40


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_groups(with_fingerprint(df)).count() == 0
    assert drop_near_duplicates(df).count() == 0


def test_similar_documents_go(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    docs, alike = [], {}
    for i in range(60):
        t = [r.choice(words) for _ in range(400)]
        docs.append((i, " ".join(t)))
        for j in range(2):  # every edit changes five shingles
            u = list(t)
            for at in r.sample(range(0, 395, 7), [4, 8][j]):
                u[at] = "edited"
            docs.append((100 + 2 * i + j, " ".join(u)))
    got = {x.doc_id for x in drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(range(60)) <= got and len(got) <= 70
