"""Hand-made cases and brute-force comparisons for the street operators."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from laneweave.functions import geo, text
from laneweave.operators import edits as log
from laneweave.operators import features, graph, projects, proximity, routing, rules, snapping, validate
from laneweave.sources import osm, schemas, store

P = schemas.POINT


def pt(lat, lng):
    return {"lat": lat, "lng": lng}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def row_of(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def test_classification_traps(spark):
    g = [{"lat": 1.0, "lon": 2.0}, {"lat": 1.0, "lon": 3.0}]
    rows = [
        ("way", 1, {"building": "yes", "highway": "primary"}, g),
        ("way", 2, {"building": "", "highway": "primary"}, g),
        ("way", 3, {"landuse": "", "leisure": "park"}, g),
        ("way", 4, {"landuse": "grass", "leisure": "park"}, g),
        ("way", 5, {"landuse": "", "leisure": ""}, g),
        ("way", 6, {"name": "x"}, g),
        ("way", 7, None, g),
        ("node", 8, {"building": "yes"}, g),
        ("way", 9, {"building": "yes"}, []),
        ("way", 10, {"building": "yes"}, None),
    ]
    df = spark.createDataFrame(rows, "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    got = {r.feature_id: (r.feature_class, r.kind, r.geometry[0].lng) for r in features.classify(df).collect()}
    assert got == {1: ("building", "yes", 2.0), 2: ("road", "primary", 2.0), 3: ("open_land", "", 2.0), 4: ("open_land", "grass", 2.0)}


def test_responses_and_quarantine(spark):
    good = json.dumps({"elements": [{"type": "way", "id": 1, "tags": {"highway": "path"}, "geometry": [{"lat": 1, "lon": 2}]}, {"type": "node", "id": 2}]})
    rows = [(1, good), (2, json.dumps({"remark": "timeout", "elements": []})), (3, "{broken"), (4, "{}"), (5, None)]
    ok, bad = osm.parse_responses(spark.createDataFrame(rows, "k int, value string"))
    assert sorted((r.k, r.element_seq, r.id) for r in ok.collect()) == [(1, 0, 1), (1, 1, 2)]
    assert sorted((r.k, r.reason) for r in bad.collect()) == [(2, "REMARK"), (3, "BAD_JSON"), (5, "BAD_JSON")]


def test_bbox_reasons_in_order(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.01, 1.0, 2.01, 2.0), (2, None, 1.0, 2.0, 1.0), (3, nan, 1.0, 2.0, 1.0), (4, inf, 1.0, 2.0, 1.0), (5, 1.0, 1.0, 2.0, 1.0), (6, 91.0, 1.0, 2.0, 1.0), (7, 2.0, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, north double, south double, east double, west double")
    got = {r.i: r.x for r in df.select("i", validate.bbox_reject_reason(F.struct("north", "south", "east", "west")).alias("x")).collect()}
    assert got == {1: None, 2: "BAD_SHAPE", 3: "NOT_FINITE", 4: "NOT_FINITE", 5: "BAD_ORDER", 6: "OUT_OF_RANGE", 7: "TOO_LARGE"}


def roads(spark, ways):
    rows = [(1, i, "road", 100 + i, kind, tags, [pt(*p) for p in g]) for i, (kind, tags, g) in enumerate(ways)]
    return spark.createDataFrame(rows, f"project_id long, feature_seq long, feature_class string, feature_id long, kind string, tags map<string,string>, geometry array<{P}>")


def test_graph_keeps_both_notions_of_an_edge(spark):
    a, b, c, near = (10.0, 10.0), (10.0, 10.001), (10.0, 10.002), (10.000001, 10.0)
    df = roads(spark, [("primary", {}, [a, b, c]), ("footway", {}, [b, a]), ("proposed", {}, [c, (11.0, 11.0)]), ("path", {"sidewalk": "no"}, [a, near]), ("service", {"sidewalk": "separate"}, [c])])
    g = graph.build_graph(df)
    assert g.segments.count() == 3 and g.edges.count() == 2 and g.nodes.count() == 3
    ab = g.edges.where("feature_id = 101").first()
    assert ab.kind == "footway" and ab.has_sidewalk  # merged last
    r = graph.network_report(df).first()
    assert (r.nodes, r.edges, r.dead_ends, r.segments, r.dead_end_segments, r.with_sidewalk, r.score) == (3, 2, 2, 3, 3, 1, 33)
    degrees = graph.node_degrees(g.segments)
    assert degrees.agg(F.sum("degree")).first()[0] == 2 * g.edges.count()


def test_drawn_sidewalk_counts_up_to_18_m(spark):
    lat = lambda m: 10.0 + m / 111320
    df = roads(spark, [("primary", {}, [(lat(0), 10.0), (lat(0), 10.001)])])
    for metres, want in ((17.9, 1), (18.1, 0)):
        path = [pt(lat(metres), 10.0), pt(lat(metres), 10.001)]
        edits = spark.createDataFrame([(1, "s", "sidewalk", path), (1, "one", "sidewalk", path[:1]), (1, "b", "bike", [pt(lat(0), 10.0)] * 2)], f"project_id long, id string, type string, path array<{P}>")
        assert graph.network_report(df, edits).first().with_sidewalk == want


def test_within_distance_is_brute_force(spark):
    r = random.Random(3)
    base = lambda: (r.choice([0.0, 59.9999, -45.0]) + r.uniform(-0.001, 0.001), r.uniform(-0.001, 0.001))
    points = [(r.choice([1, 2]), i, pt(*base())) for i in range(300)]
    segments = []
    for _ in range(60):
        a = base()
        segments.append((r.choice([1, 2]), pt(*a), pt(a[0] + r.uniform(-0.001, 0.001), a[1] + r.uniform(-0.002, 0.002))))
    pd, sd = spark.createDataFrame(points, f"project_id long, i int, p {P}"), spark.createDataFrame(segments, f"project_id long, a {P}, b {P}")
    got = sorted(x.i for x in proximity.within_distance(pd, sd).collect())
    brute = pd.crossJoin(sd.withColumnRenamed("project_id", "q")).where(F.col("project_id") == F.col("q")).where(geo.point_segment_m(F.col("p"), F.col("a"), F.col("b")) <= 18)
    assert got == sorted({x.i for x in brute.select("i").distinct().collect()}) and 5 < len(got) < 295


def test_nearest_ties_go_to_the_first(spark):
    g = [(10.0, 10.0), (10.0, 10.0005), (10.0, 10.001)]
    df = roads(spark, [("x", {}, g), ("y", {}, g)])
    points = row_of(spark, f"project_id long, point_id long, p {P}, zoom double", 1, 7, pt(10.00005, 10.0005), 17.0)
    hit = proximity.nearest_segment(points, snapping.snap_segments(df)).first()
    assert (hit.feature_seq, hit.segment_index) == (0, 0)
    far = row_of(spark, f"project_id long, point_id long, p {P}, zoom double", 1, 8, pt(10.01, 10.0005), 17.0)
    assert proximity.nearest_segment(far, snapping.snap_segments(df)).first().distance is None


def test_path_between_runs_both_ways(spark):
    g = F.array(*[F.struct(F.lit(float(i)).alias("lat"), F.lit(0.0).alias("lng")) for i in range(6)])
    snap = lambda v, i: F.struct(F.struct(F.lit(v).alias("lat"), F.lit(0.0).alias("lng")).alias("map_point"), F.lit(i).alias("segment_index"))
    lats = lambda c: F.transform(c, lambda p: p["lat"])
    r = one(spark, f=lats(snapping.path_between(g, snap(1.5, 1), snap(4.5, 4))), b=lats(snapping.path_between(g, snap(4.5, 4), snap(1.5, 1))), s=lats(snapping.path_between(g, snap(2.7, 2), snap(2.2, 2))))
    assert r.f == [1.5, 2, 3, 4, 4.5] and r.b == [4.5, 4, 3, 2, 1.5] and r.s == [2.7, 2.2]


def test_snapping_each_tool(spark):
    df = roads(spark, [("residential", {}, [(10.0, 10.0), (10.0, 10.001), (10.0, 10.002)])])
    at = lambda lat, lng: pt(10.0 + lat * 1e-5, 10.0 + lng * 1e-5)
    drafts = [
        (1, 1, "road", at(2, 20), at(-2, 150), 18.0),
        (1, 2, "bike", at(900, 20), at(2, 150), 18.0),
        (1, 3, "crossing", at(3, 50), at(-1, 50), 18.0),
        (1, 4, "roundabout", at(3, 101), at(3, 102), 18.0),
        (1, 5, "signal", at(9, 9), at(1, 1), 18.0),
    ]
    d = spark.createDataFrame(drafts, schemas.DRAFTS)
    none = spark.createDataFrame([], "project_id long, edit_seq long, id string, type string, center struct<lat:double,lng:double>, pixel_radius double, zoom double")
    got = {r.draft_id: r for r in snapping.snap_all(d, df, none).collect()}
    assert got[1].snapped and [round((p.lng - 10) * 1e5) for p in got[1].path] == [20, 100, 150] and all(abs(p.lat - 10) < 1e-9 for p in got[1].path)
    assert not got[2].snapped and got[2].path[0].lat == pytest.approx(10.009)
    assert abs(got[3].pixel_vector.x) < 1e-6 and abs(abs(got[3].pixel_vector.y) - 30) < 1e-6  # across the street, 30 pixels
    assert got[4].center == (10.0, 10.001) and got[4].pixel_radius == 12
    assert got[5].point == (10.00009, 10.00009)
    ring = spark.createDataFrame([(1, 1, "r", "roundabout", at(2, 20), 12.0, 18.0)], "project_id long, edit_seq long, id string, type string, center struct<lat:double,lng:double>, pixel_radius double, zoom double")
    ringed = {r.draft_id: r for r in snapping.snap_lines(d, df, snapping.roundabout_ring(ring)).collect()}
    assert ringed[1].snapped and len(ringed[1].path) == 2
    assert snapping.roundabout_ring(ring).count() == 8


def test_routes_as_dijkstra(spark):
    r = random.Random(5)
    nodes = [(10 + i // 6 * 1e-3, 10 + i % 6 * 1e-3) for i in range(36)]
    ways = [("service", {}, [nodes[i], nodes[j]]) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j - i == 6 or j % 6) and r.random() < 0.8]
    df = roads(spark, ways + [("service", {}, [(20.0, 20.0), (20.0, 20.001)])])
    g = graph.build_graph(df)
    edges = [(tuple(e.u), tuple(e.v), e.length_m) for e in g.edges.collect()]
    start = tuple(g.nodes.agg(F.min("node")).first()[0])
    best = {start: 0.0}
    for _ in range(50):
        for u, v, w in edges:
            for a, b in ((u, v), (v, u)):
                if a in best and best[a] + w < best.get(b, math.inf):
                    best[b] = best[a] + w
    source = g.nodes.where(F.struct("node.lat_e6", "node.lng_e6") == F.struct(F.lit(start[0]).alias("lat_e6"), F.lit(start[1]).alias("lng_e6"))).select(F.lit(1).alias("route_id"), "project_id", "node")
    labels = routing.shortest_distances(graph.adjacency(g.edges), source)
    got = {tuple(x.node): x.distance_m for x in labels.collect()}
    assert got.keys() == best.keys() and all(got[k] == pytest.approx(best[k]) for k in best)
    far = max(best, key=best.get)
    target = labels.where(F.struct("node.lat_e6", "node.lng_e6") == F.struct(F.lit(far[0]).alias("lat_e6"), F.lit(far[1]).alias("lng_e6"))).select("route_id", "project_id", "node")
    assert routing.path_lengths(routing.route_paths(labels, target), g.edges).first().length_m == pytest.approx(best[far])
    ask = lambda i, a, b: (i, 1, pt(*a), pt(*b), 17.0)
    some = lambda k: (k[0] / 1e6, k[1] / 1e6)
    rows = [ask(1, some(start), some(far)), ask(2, some(start), some(start)), ask(3, some(start), (50.0, 50.0)), ask(4, some(start), (20.0, 20.0))]
    out = {x.route_id: (x.status, x.distance_m) for x in routing.route(spark.createDataFrame(rows, f"route_id long, project_id long, origin {P}, destination {P}, zoom double"), g).collect()}
    assert out[1] == ("OK", pytest.approx(best[far])) and out[2][0] == "SAME_NODE" and out[3][0] == "NO_NODE" and out[4][0] == "NO_ROUTE"


def test_rules_edges(spark):
    p = spark.createDataFrame([(1, None, (1.0, 0.99, 1.0, 0.99)), (2, " A ", (2.0, 0.0, 2.0, 0.0)), (3, "B", (1.0, 0.99, 1.0, 0.99))], f"project_id long, name string, bbox {schemas.BBOX}")
    e = spark.createDataFrame([(2, "a", "crossing"), (2, "b", "crossing"), (2, "c", "signal"), (2, None, "signal"), (2, "d", None), (3, "x", "tram")], "project_id long, id string, type string")
    f = spark.createDataFrame([], "project_id long, feature_class string")
    got = {r.project_id: r for r in rules.analyze(p, e, f).collect()}
    assert got[1].summary.startswith("This project: nothing") and got[1].safety == ["SAFE_DEFAULT"] and got[1].pedestrian == []
    assert got[2].summary == "A: adds 2 crossings, 1 traffic signal among 0 mapped roads" and got[2].suggestions == ["SUG_SMALLER_AREA"]
    assert got[3].summary == "B: adds  among 0 mapped roads"  # an unknown kind counts in the total only
    assert set(rules.WORDING) >= {c for r in got.values() for c in [*r.safety, *r.pedestrian, *r.suggestions]}
    r = one(spark, a=rules.provider_reject_reason(F.lit("RULES")), b=rules.provider_reject_reason(F.lit("other")), c=rules.provider_reject_reason(F.lit(None).cast("string")))
    assert (r.a, r.b, r.c) == (None, "UNKNOWN_PROVIDER", None)


def test_store_round_trip_and_ownership(spark, tmp_path):
    now = F.lit("2024-01-02 00:00:00")
    p = spark.createDataFrame([("p1", "u1", "old", (1.0, 0.0, 1.0, 0.0), None, None)], schemas.PROJECTS)
    s = spark.createDataFrame([("p1", "{}", "[]")], schemas.STATE)
    box, bad = (1.0, 0.0, 1.0, 0.0), (None, 0.0, 1.0, 0.0)
    req = [(1, "u1", "p1", " new ", box, "{}", "[1]"), (2, "u2", "p1", "theirs", box, "{}", "[2]"), (3, "u2", "", "mine", box, "{}", "[3]"), (4, "u1", "p1", " ", box, "{}", "[]"), (5, "u1", "p1", "x", bad, "{}", "[]"), (6, "u1", "p1", "x", box, None, "[]"), (7, "u1", "p1", "x", box, "{}", "{}"), (8, "u1", "p9", "never", box, "{}", "[]")]
    r = spark.createDataFrame(req, schemas.SAVE_REQUESTS)
    saved, rejected, accepted = projects.save_projects(p, r, now)
    got = {x.name: x for x in saved.collect()}
    assert set(got) == {"new", "mine"} and got["new"].id == "p1" and got["mine"].user_id == "u2"
    assert {x.seq: x.reject_reason for x in rejected.collect()} == {2: "NOT_FOUND", 4: "NO_NAME", 5: "BAD_BBOX", 6: "NO_OSM_DATA", 7: "BAD_EDITS", 8: "NOT_FOUND"}
    state = projects.upsert_state(s, accepted)
    assert {x.user_edits for x in state.collect()} == {"[1]", "[3]"}
    assert sorted(x.user_edits for x in projects.upsert_state(state, accepted).collect()) == ["[1]", "[3]"]  # again changes nothing
    users = projects.ensure_users(spark.createDataFrame([("u1", "u1", "mail", None)], schemas.USERS), r.select("user_id"), now)
    assert {x.id: x.email for x in users.collect()} == {"u1": "mail", "u2": None}
    root = str(tmp_path / "store")
    store.write_store({"users": users, "projects": saved, "state": state}, root)
    back = store.read_store(spark, root)
    assert projects.get_project(back["projects"], back["state"], "p1", "u1").count() == 1 and projects.get_project(back["projects"], back["state"], "p1", "u2").count() == 0
    assert [x.name for x in projects.list_projects(back["projects"], "u2").collect()] == ["mine"]
    left = projects.delete_users(back, spark.createDataFrame([("u2",)], "user_id string"))
    assert [left[t].count() for t in ("users", "projects", "state")] == [1, 1, 1]


def model(events):
    current, undone = [], []
    for action, i in events:
        if action == "add":
            current, undone = [*current, i], []
        elif action == "remove":
            current, undone = [x for x in current if x != i], []
        elif action == "undo" and current:
            undone.append(current.pop())
        elif action == "redo" and undone:
            current.append(undone.pop())
        elif action == "load":
            current, undone = ["l1", "l2"], []
    return current, undone


def events(n=40, seed=7):
    r = random.Random(seed)
    out = []
    for p in range(n):
        ids = []
        for s in range(r.randint(1, 25)):
            action = r.choice(["add", "add", "undo", "redo", "remove", "odd", *(["load"] if r.random() < 0.1 else [])])
            ids.append(f"e{s}")
            out.append((p, s, action, r.choice(ids) if action == "remove" else f"e{s}"))
    return out


def test_replay_is_the_model(spark):
    rows = events()
    load = json.dumps([{"id": "l1", "object": "{}"}, {"id": "l2", "object": "{}"}])
    df = spark.createDataFrame([(p, s, a, i, load if a == "load" else "{}") for p, s, a, i in rows], "project_id long, seq long, action string, id string, object string").repartition(4)
    got = {r.project_id: ([e.id for e in r.current], [e.id for e in r.undone]) for r in log.replay(df).collect()}
    want = {p: model([(a, i) for q, _, a, i in rows if q == p]) for p in range(40)}
    assert got == want
    last = {r.project_id: r.last for r in log.last_edit(log.replay(df)).collect()}
    assert all((last[p] is None) == (not w[0]) for p, w in want.items())


def test_replay_on_a_stream_is_the_batch(spark, tmp_path):
    from laneweave.streaming.edits import autosave_stream, replay_stream

    rows = [(p, s, F"2024-01-01 00:{s:02d}:00", a, i, "[]" if a == "load" else "{}") for p, s, a, i in events(8, 3)]
    df = spark.createDataFrame(rows, "project_id long, seq long, ts string, action string, id string, object string").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    for low, high in ((0, 8), (8, 16), (16, 99)):  # three micro-batches
        df.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = replay_stream(stream).writeStream.outputMode("update").format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("replayed").orderBy("seq").collect():
        got[r.project_id] = (r.current_ids, r.undone_ids)
    want = {r.project_id: (",".join(e.id for e in r.current), ",".join(e.id for e in r.undone)) for r in log.replay(df).collect()}
    assert got == want
    q = autosave_stream(stream.withColumn("state", F.col("id"))).writeStream.outputMode("append").format("memory").queryName("saved").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("saved").columns == ["project_id", "saved_at", "first_change", "last_change", "changes", "signature"]


def test_autosave_skips_equal_content(spark):
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:01:00", "b"), (1, "2024-01-01 00:10:00", "b"), (1, "2024-01-01 00:20:00", "c"), (2, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "project_id long, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.project_id, str(r.saved_at)[11:], r.changes) for r in log.autosave_points(df).collect())
    assert got == [(1, "00:03:00", 2), (1, "00:22:00", 1), (2, "00:02:00", 1)]


def test_gestures_and_boxes(spark):
    d = spark.createDataFrame([(1, 1, "road", pt(10.0, 10.0), pt(10.0, 10.0), 16.0), (1, 2, "road", pt(10.0, 10.0), pt(10.0, 10.001), 16.0)], schemas.DRAFTS)
    assert [r.draft_id for r in validate.keep_gestures(d).collect()] == [2]
    at = lambda x: {"x": x, "y": x}
    b = spark.createDataFrame([(1, at(1e7), at(1e7 + 7), 16.0), (2, at(1e7), at(1e7 + 100), 16.0), (3, at(1e7), at(1e7 + 9000), 16.0)], "i int, p struct<x:double,y:double>, q struct<x:double,y:double>, zoom double")
    assert [r.i for r in validate.keep_boxes(b).collect()] == [2]


def test_small_functions(spark):
    r = one(spark, a=text.format_distance(F.lit(999.5)), b=text.format_distance(F.lit(1234.0)), c=text.plural(F.lit(1), "sign"), d=text.plural(F.lit(0), "sign"), e=text.name_or_default(F.lit("  ")), f=text.new_id(F.lit("k")), g=text.format_stamp(F.lit("2024-03-05 14:07:00").cast("timestamp")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("1000 m", "1.23 km", "1 sign", "", text.DEFAULT_NAME) and len(r.f) == 32 and r.g == "Mar 5, 2024, 2:07 PM"
    u = one(spark, z=geo.unit(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), s=text.signature(F.lit(1), F.lit(None)), t=text.signature(F.lit(1)))
    assert tuple(u.z) == (1.0, 0.0) and u.s != u.t
    docs = spark.createDataFrame([(1, [{"id": 1, "kind": "a", "geometry": []}]), (2, [{"id": None, "kind": "a", "geometry": []}]), (3, [])], "k int, f array<struct<id:long,kind:string,geometry:array<double>>>")
    assert {x.k: x.ok for x in docs.select("k", validate.document_is_valid(F.col("f")).alias("ok")).collect()} == {1: True, 2: False, 3: True}
    path = F.array(*[F.struct(F.lit(10.0).alias("lat"), F.lit(v).alias("lng")) for v in (10.0, 10.001)])
    near = one(spark, a=geo.any_within(F.struct(F.lit(10.0001).alias("lat"), F.lit(10.0005).alias("lng")), path, 18), b=geo.any_within(F.struct(F.lit(10.001).alias("lat"), F.lit(10.0).alias("lng")), path, 18))
    assert near.a and not near.b


def test_area_selection_by_crossing(spark):
    way = lambda i, *p: ("way", i, {"highway": "x"}, [{"lat": a, "lon": b} for a, b in p])
    rows = [way(1, (0.0, -1.0), (0.0, 1.0)), way(2, (5.0, 5.0), (6.0, 6.0)), way(3, (0.05, 0.05)), way(4, (-1.0, 0.0), (0.0, -1.0)), ("way", 5, {"name": "n"}, [{"lat": 0.0, "lon": 0.0}])]
    df = spark.createDataFrame(rows, "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    box = spark.createDataFrame([(9, 0.1, -0.1, 0.1, -0.1)], schemas.AREAS)
    got = osm.select_area(df, box).select("area_id", "id").collect()
    assert sorted(map(tuple, got)) == [(9, 1), (9, 3)]
