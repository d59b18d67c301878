import time

from pyspark.sql import functions as F

from laneweave.operators import graph, proximity, routing

AT = "named_struct('lat', {}, 'lng', {})"


def test_repeated_points_and_segments_are_met_once(spark):
    """Twenty thousand of each in one cell, farther apart than the cutoff; the points that are near come out one for one."""
    points = spark.range(20_000).selectExpr("1L as project_id", "id", f"case when id % 10000 = 7 then {AT.format('0.0002D', '0D')} else {AT.format('0D', '0D')} end as p")
    segments = spark.range(20_000).selectExpr("1L as project_id", f"{AT.format('0.0003D', '0D')} as a", f"{AT.format('0.0003D', '0.0001D')} as b")
    began = time.monotonic()
    got = proximity.within_distance(points.repartition(8), segments.repartition(8)).select("id").collect()
    assert sorted(r.id for r in got) == [7, 10_007]
    assert time.monotonic() - began < 30


def test_ways_between_the_same_nodes_are_searched_once(spark, monkeypatch):
    """Forty routes along one road, to and fro, and one that has no node."""
    line = ", ".join(AT.format("50D", f"{8 + k / 1000}D") for k in range(6))
    roads = spark.sql(f"select 1L as project_id, 1L as feature_id, 1L as feature_seq, 'road' as feature_class, 'primary' as kind, map('a', 'b') as tags, array({line}) as geometry")
    near, far = AT.format("50.00001D", "8D"), AT.format("50.00001D", "8.005D")
    requests = spark.range(41).selectExpr("id as route_id", "1L as project_id", f"if(id % 2 = 0, {near}, {far}) as origin", f"case when id = 40 then {AT.format('51D', '9D')} when id % 2 = 0 then {far} else {near} end as destination", "16D as zoom")
    searched, search = [], routing.search_between

    def counted(neighbours, pairs, *rest):
        searched.append(pairs.count())
        return search(neighbours, pairs, *rest)

    monkeypatch.setattr(routing, "search_between", counted)
    answers, ways = routing.route_with_ways(requests, graph.build_graph(roads))
    assert searched == [2]
    got = {r.route_id: (r.status, r.distance_m) for r in answers.collect()}
    assert len(got) == 41 and got[40] == ("NO_NODE", None)
    assert {s for i, (s, _) in got.items() if i < 40} == {"OK"} and len({round(m, 3) for i, (_, m) in got.items() if i < 40}) == 1
    order = F.transform(F.array_sort(F.collect_list(F.struct("position", "node.lng_e6"))), lambda x: x["lng_e6"])
    there = [8_000_000 + 1000 * k for k in range(6)]
    way = {r.route_id: r.w for r in ways.groupBy("route_id").agg(order.alias("w")).collect()}
    assert way == {i: there if i % 2 == 0 else there[::-1] for i in range(40)}
