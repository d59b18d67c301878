import math
import random

import pytest

from laneweave.operators import graph, routing
from laneweave.plans import fixtures, queries


def test_every_request_is_answered(spark, sf):
    got = [r.route_id for r in queries.route_requests(spark, sf).select("route_id").collect()]
    assert sorted(got) == sorted(r.point_id for r in fixtures.pins(spark, sf).select("point_id").collect())


def grid_graph(spark, seed, side=7, keep=0.7, projects=(1, 2)):
    """Streets of equal length and others, in pieces that do not all hang together."""
    r = random.Random(seed)
    rows = []
    for p in projects:
        key = lambda i: {"lat_e6": 10_000_000 + (i // side) * 1000, "lng_e6": 20_000_000 + (i % side) * 1000}
        for i in range(side * side):
            for j in (i + 1, i + side):
                if j < side * side and (j - i == side or j % side) and r.random() < keep:
                    rows.append((p, key(i), key(j), 200.0 if r.random() < 0.8 else r.uniform(150, 900)))
    k = "struct<lat_e6:bigint,lng_e6:bigint>"
    return rows, spark.createDataFrame(rows, f"project_id long, u {k}, v {k}, length_m double")


def brute(rows, project, source):
    best = {source: 0.0}
    for _ in range(200):
        for p, u, v, w in rows:
            u, v = tuple(u.values()), tuple(v.values())
            for a, b in ((u, v), (v, u)):
                if p == project and a in best and best[a] + w < best.get(b, math.inf) - 1e-9:
                    best[b] = best[a] + w
    return best


@pytest.mark.parametrize("seed,keep", [(1, 0.7), (2, 0.5)])
def test_ways_between_pairs_are_shortest_and_whole(spark, seed, keep):
    rows, edges = grid_graph(spark, seed, keep=keep)
    r = random.Random(seed)
    nodes = sorted({(p, *tuple(n.values())) for p, u, v, _ in rows for n in (u, v)})
    asked = []
    while len(asked) < 60:
        a, b = r.choice(nodes), r.choice(nodes)
        if a[0] == b[0] and a != b:
            asked.append((len(asked), a[0], a[1:], b[1:]))
    k = "struct<lat_e6:bigint,lng_e6:bigint>"
    pairs = spark.createDataFrame(asked, f"route_id long, project_id long, source {k}, target {k}").repartition(3)
    neighbours = graph.adjacency(edges)
    found = routing.search_between(neighbours, pairs)
    lengths = {x.route_id: x.distance_m for x in found.lengths.collect()}
    way = {}
    for x in routing.ways(found, neighbours).orderBy("route_id", "position").collect():
        way.setdefault(x.route_id, []).append((x.position, tuple(x.node)))
    weight = {(p, *sorted((tuple(u.values()), tuple(v.values())))): w for p, u, v, w in rows}
    none = 0
    for i, p, a, b in asked:
        want = brute(rows, p, a).get(b)
        assert lengths[i] == (None if want is None else pytest.approx(want))
        if want is None:
            none += 1
            assert i not in way
            continue
        places = [n for _, n in way[i]]
        assert [at for at, _ in way[i]] == list(range(len(places))) and places[0] == a and places[-1] == b
        assert sum(weight[(p, *sorted(step))] for step in zip(places, places[1:])) == pytest.approx(want)
    assert none if keep < 0.6 else len(way) > 50


def test_a_target_bounds_the_search_and_empty_requests_give_nothing(spark):
    rows, edges = grid_graph(spark, 3, keep=1.0, projects=(1,))
    k = "struct<lat_e6:bigint,lng_e6:bigint>"
    a, b = (10_000_000, 20_000_000), (10_001_000, 20_001_000)
    source = spark.createDataFrame([(5, 1, a), (None, 1, a), (6, 1, None)], f"route_id long, project_id long, node {k}")
    target = spark.createDataFrame([(5, b)], f"route_id long, node {k}")
    full = {tuple(x.node): x.distance_m for x in routing.shortest_distances(graph.adjacency(edges), source).collect()}
    some = {tuple(x.node): x.distance_m for x in routing.shortest_distances(graph.adjacency(edges), source, targets=target).collect()}
    assert full == {n: pytest.approx(m) for n, m in brute(rows, 1, a).items()} and some[b] == full[b] and len(some) < len(full) - 10
    none = spark.createDataFrame([], f"route_id long, project_id long, source {k}, target {k}")
    found = routing.search_between(graph.adjacency(edges), none)
    assert found.lengths.count() == 0 and routing.ways(found, graph.adjacency(edges)).count() == 0


def test_a_way_of_a_thousand_hops(spark):
    key = "named_struct('lat_e6', 5000000 + {0} * 20, 'lng_e6', 7000000L)"
    labels = spark.range(1000).selectExpr("1L as route_id", "1L as project_id", f"{key.format('id')} as node", "double(id) as distance_m", f"case when id > 0 then {key.format('(id - 1)')} end as pred")
    target = labels.where("distance_m = 999").select("route_id", "project_id", "node")
    got = routing.route_paths(labels, target).collect()
    assert sorted((x.hops_left, x.node.lat_e6) for x in got) == [(i, 5_000_000 + (999 - i) * 20) for i in range(1000)]
