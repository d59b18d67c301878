import random

import numpy as np
import pyarrow as pa
import pytest

from laneweave.llm import minhash, shingles
from laneweave.llm.minhash import COORDS, near_set_groups, sketches

SCHEMA = "doc_id long, text string, component_id string, kept int, n_shingles string"


def shingle_set(text, k=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(sets[i]), best.get(find(i)), d == best.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def data(seed=3):
    r = random.Random(seed)
    words = [f"Wörd{i}" if i % 5 == 0 else f"word{i}" for i in range(400)]
    rows = []
    for i in range(40):
        t = [r.choice(words) for _ in range(r.choice([1, 3, 4, 7, 8, 30, 200, 600]))]
        rows.append((1000 - i, " ".join(t), "x", 1, "y"))
        for j in range(r.randint(0, 4)):
            u = list(t)
            for _ in range(r.randint(0, 1 + len(u) // 30)):
                u[r.randrange(len(u))] = r.choice(words)
            rows.append((2000 + 10 * i + j, "\t".join(u).upper(), "x", 1, "y"))
    # A template with a few words of its own in each: many buckets, few links.
    base = [r.choice(words) for _ in range(60)]
    for i in range(120):
        u = list(base)
        for _ in range(r.randint(1, 6)):
            u[r.randrange(len(u))] = f"own{i}"
        rows.append((5000 + i, " ".join(u), None, None, None))
    rows += [(7000 + i, rows[5][1], "", 0, "") for i in range(30)]
    # A repeated pattern, and four of five shingles: exactly the least similarity.
    rows += [(8000, "la la " * 300, "", 0, ""), (8001, "la la " * 200, "", 0, ""), (8002, "a b c d e f g", "", 0, ""), (8003, "a b c d e f g h", "", 0, "")]
    return rows + [(1, None, None, None, None), (2, "", "", 0, ""), (3, " \n\t", "", 0, ""), (None, "only one here", "", 0, ""), (None, rows[0][1], "", 0, ""), (9, rows[0][1], "", 0, ""), (10, "solo text", "", 0, ""), (10, "solo text", "", 0, ""), rows[0], rows[0]]


@pytest.mark.parametrize("limits", [{}, {"leader_rows": 5, "cluster_limit": 2000}])
def test_as_brute_force(spark, limits):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = near_set_groups(df, **limits)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in out.collect()), key=str)
    assert got == brute(rows)
    assert len({g[2] for g in got}) < len(got) - 60 and sum(not g[3] for g in got) > 60


def test_empty_and_only_nulls(spark):
    df = spark.createDataFrame([(None, "x y z"), (None, None)], "doc_id long, text string")
    assert near_set_groups(df.limit(0)).count() == 0
    assert sorted((x.n_shingles, x.component_id, x.kept) for x in near_set_groups(df).collect()) == [(0, None, True), (1, None, True)]


def test_every_coordinate_is_filled_and_agreements_concentrate():
    rng = np.random.default_rng(5)
    for size in (4, 5, 9, 60, 500, 5000):
        pool = rng.integers(0, 1 << 63, 40 * size).astype(np.uint64)
        worst = []
        for i in range(20):
            own = pool[i * 2 * size : (i * 2 + 1) * size]
            common = int(size * 0.8)
            other = np.r_[own[:common], pool[(i * 2 + 1) * size : (i * 2 + 2) * size - common]]
            s = sketches(np.r_[np.sort(own), np.sort(other)], np.array([0, len(own), len(own) + len(other)]))
            assert s.shape == (2, COORDS) and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
            worst.append((s[0] == s[1]).mean() - common / (2 * size - common))
        assert abs(np.mean(worst)) < 0.03 and np.abs(worst).max() < 0.2


def test_sketch_is_of_the_set_alone():
    h = np.array([5, 9, 11, 40, 41, 77], np.uint64)
    together = sketches(np.r_[h, h[1:], h], np.array([0, 6, 11, 17]))
    assert (together[0] == together[2]).all() and (together[0] == sketches(h, np.array([0, 6]))[0]).all()
    assert (minhash.bands(together)[0] == minhash.bands(together)[2]).all()


def test_a_very_long_text(spark):
    text = " ".join(str(i * i % 1_000_003) for i in range(400_000))
    rows = [(1, text), (2, text + " and some more"), (3, text[: len(text) // 2])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_set_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (len(shingle_set(t)), c) for (d, t), c in zip(rows, (1, 1, 3))}
    h, at = shingles.shingle_sets(pa.array([text]), 4)
    assert at[-1] == len(h) == got[1][0]
