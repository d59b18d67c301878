import random
from itertools import combinations

import numpy as np
import pytest

from laneweave.llm import shingles
from laneweave.llm.simhash import drop_near_duplicates, link_group


def texts(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(r.choice(words) for _ in range(30))
    out = []
    for n in (6, 9, 14, 25, 60, 200, 200, 700):
        for _ in range(6):
            t = [r.choice(words) for _ in range(n)]
            out.append(" ".join(t))
            for share in (0.01, 0.02, 0.03, 0.04, 0.05):  # an edit changes up to five shingles
                u = list(t)
                for at in r.sample(range(n), max(1, round(n * share))):
                    u[at] = r.choice(words)
                out += [" ".join(u), " ".join(t + u[: max(1, int(n * 5 * share))])]
    for _ in range(20):  # one line many times, and little else
        out.append("\n".join([line] * 40 + [" ".join(r.choice(words) for _ in range(60))]))
    return out


def sets(texts, k=5):
    return [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if (w := t.lower().split()) else frozenset() for t in texts]


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(data):
    """The first of each component, by all pairs."""
    own, root = sets(data), list(range(len(data)))
    for i, j in combinations(range(len(data)), 2):
        if root[i] != root[j] and alike(own[i], own[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return {i for i, x in enumerate(root) if i == x}


def test_prefixes_and_bounds_lose_no_pair(spark):
    """Holds for any number of documents: neither prefix nor bound depends on it."""
    data = texts()
    own = sets(data)
    rows = {r.id: r for r in shingles.with_shingle_marks(spark.createDataFrame(list(enumerate(data)), "id long, text string"), ["id"], "text", 5).collect()}
    assert [rows[i].size for i in range(len(data))] == [len(s) for s in own]
    pairs = [(i, j) for i, j in combinations(range(len(data)), 2) if alike(own[i], own[j])]
    assert len(pairs) > 300 and any(5 * len(own[i] & own[j]) < 4.2 * len(own[i] | own[j]) for i, j in pairs)
    for i, j in pairs:
        a, b = rows[i], rows[j]
        assert set(a.prefix) & set(b.prefix)
        words = np.array([[r[m] for m in shingles.MARKS] for r in (a, b)]).view(np.uint64)
        label = link_group(words, shingles.MAX_BITS, np.array([a.size, b.size]))
        assert label[0] == label[1]


@pytest.mark.parametrize("limits", [(8_000, 1_000_000), (3, 300)])
def test_every_link_of_the_search_in_chunks_too(spark, monkeypatch, limits):
    monkeypatch.setattr(shingles.candidates, "__defaults__", limits[:1])
    monkeypatch.setattr(shingles.verified, "__defaults__", limits[1:])
    data = texts(4)
    got = drop_near_duplicates(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in got.collect()} == kept(data)
