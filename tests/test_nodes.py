import itertools
import random

from laneweave.operators import graph
from laneweave.sources import schemas

KEY = "struct<lat_e6:bigint,lng_e6:bigint>"


def test_ends_are_merged_without_a_sort(spark):
    """The first and the last end of each node, nulls before all numbers; segments are read once and their ends hashed."""
    rng = random.Random(4)
    numbers = itertools.product([None, -(2**63), -1, 0, 1, 2**63 - 1], [None, -(2**31), 0, 1, 2**31 - 1], range(2))
    spot = lambda: (rng.random(), None if rng.random() < 0.2 else rng.random())
    rows = [(i // 15 % 3, seq, index, spot(), spot(), (rng.randrange(3), 1), (rng.randrange(3), 2)) for i, (seq, index, _) in enumerate(numbers)]
    rows = list({row[:3]: row for row in rows}.values())
    segments = spark.createDataFrame(rows, f"project_id bigint, feature_seq bigint, segment_index int, a {schemas.POINT}, b {schemas.POINT}, a_key {KEY}, b_key {KEY}").repartition(3)
    nodes = graph.graph_nodes(segments)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan and plan.count("Union") == 0
    ends = {}
    for project, seq, index, a, b, a_key, b_key in rows:
        for end, key, p in ((0, a_key, a), (1, b_key, b)):
            ends.setdefault((project, key), []).append((tuple((v is not None, v or 0) for v in (seq, index, end)), (seq, index, end), p))
    got = {(r.project_id, tuple(r.node)): (tuple(r.node_seq), tuple(r.point)) for r in nodes.collect()}
    assert got == {k: (min(v)[1], max(v, key=lambda e: e[0])[2]) for k, v in ends.items()} and len(got) == 18
