import random

import numpy as np
import pyarrow as pa
import pytest

from laneweave.llm.negatives import hard_negatives, packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, tag string, score int"


def usable(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e)


def brute(rows, every, k, m, factor, low=50, high=95):
    plain = {}
    for i, e, label, *_ in rows:
        if i is not None and label is not None and usable(e):
            plain[i, label, tuple(int(np.floor(factor * float(np.float32(x)))) for x in e)] = None
    out = []
    for a, own, v in plain:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in plain if i != a and len(w) == len(v)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == own][:k]:
            fit = [(n, i) for n, i, label in scored if label != own and low * -s <= 100 * -n <= high * -s][:m]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def data(seed=1, n=400, dims=6):
    r = random.Random(seed)
    rows = [(i, [r.choice([-0.5, -0.25, 0.0, 0.25, 0.5, r.uniform(-1, 1)]) for _ in range(dims)], r.randrange(4), "t", 7) for i in range(n)]
    hot = rows[11][1]
    rows += [(1000 + i, hot, r.randrange(3), "t", 7) for i in range(150)]  # copies: ties
    rows += [(2000 + 10 * i, [0.0] * dims, i % 3, "t", 7) for i in range(6)]  # scores of 0
    rows += [(-10 * i, rows[i][1], 2, "t", 7) for i in range(1, 8)]
    rows += [(3000, None, 1, "t", 7), (3010, [0.1, None] * (dims // 2), 1, "t", 7), (3020, [float("nan")] + [0.1] * (dims - 1), 1, "t", 7), (3030, [float("inf")] * dims, 0, "t", 7), (3040, hot, None, "t", 7), (None, hot, 1, "t", 7), (3050, [0.5, 0.5], 0, "t", 7), (3051, [0.25, 0.5], 0, "t", 7), (3052, [0.5, 0.1], 1, "t", 7), (3060, [], 0, "t", 7)]
    return rows + [rows[20], rows[20], rows[3]]


@pytest.mark.parametrize("chunk,keys", [(16_384, 500_000), (50, 100)])
def test_as_brute_force(spark, chunk, keys):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = hard_negatives(df, every=10, chunk_rows=chunk, key_rows=keys)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(x) for x in out.collect())
    want = brute(rows, 10, 5, 3, 256)
    assert got == want and len(want) > 300
    assert any(x[4] == 0 for x in want)  # a window of the score 0 alone


def test_one_label_holds_all_but_a_few(spark):
    rows = [(i, e, 0 if i % 40 else 1, t, s) for i, e, _, t, s in data(seed=2) if i is not None]
    got = sorted(tuple(x) for x in hard_negatives(spark.createDataFrame(rows, SCHEMA), every=7, positives=2, negatives=4, factor=64, chunk_rows=90).collect())
    assert got == brute(rows, 7, 2, 4, 64)


def test_empty_and_too_large(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    assert hard_negatives(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large for exact scores"):
        hard_negatives(spark.createDataFrame([(50, [1e30, 1.0], 1, "", 0)], SCHEMA)).count()


def test_keys_sort_as_numbers():
    r = random.Random(1)
    edge = [-(1 << 63), -5, -1, 0, 1, 9, (1 << 62), (1 << 63) - 1]
    rows = [(r.choice(edge), r.choice(edge), r.choice(edge), r.choice(edge), r.choice([0, 1])) for _ in range(500)]
    keys = packed(*[np.array(c, np.int64) for c in list(zip(*rows))[:4]], np.array([x[4] for x in rows]))
    order = sorted(range(len(rows)), key=lambda i: keys[i].as_py())
    assert [rows[i] for i in order] == sorted(rows, key=lambda x: (x[0], x[1], -x[2], x[4], x[3]))
    assert [tuple(x) for x in zip(*(c.tolist() for c in unpacked(keys)))] == [(a, t, s, i, bool(n)) for a, t, s, i, n in rows]
    assert len(unpacked(pa.array([], pa.binary()))[0]) == 0
