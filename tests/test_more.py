import json

import pytest
from pyspark.sql import functions as F

from laneweave.functions import geo
from laneweave.operators import edits, features, routing, rules, snapping, validate
from laneweave.plans import queries
from laneweave.sources import osm, schemas


def test_files_of_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "tags": {"leisure": "park"},\
 "geometry": [{"lat": 1.5, "lon": 2.5}]}]}, indent=1))
    (tmp_path / "b.json").write_text("nothing of the kind")
    good, bad = osm.read_elements(spark, str(tmp_path))
    assert [(r.id, r.file.endswith("a.json")) for r in good.collect()] == [(5, True)]
    assert [r.reason for r in bad.collect()] == ["BAD_JSON"]


def test_documents(spark):
    f = spark.createDataFrame([(1, 1, "road", 7, "path", {"a": "b"}, [(1.0, 2.0)]), (1, 0, "road", 8, "x", {}, [(1.0, 2.0)])], schemas.FEATURES)
    a = spark.createDataFrame([(1, 1.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 1.0, 0.0)], schemas.AREAS)
    got = {r.area_id: json.loads(r.document) for r in osm.area_document(f, a).collect()}
    assert [x["id"] for x in got[1]["roads"]] == [8, 7] and got[1]["counts"] == {"buildings": 0, "roads": 2, "openLand": 0}
    assert got[2]["roads"] == [] and got[2]["bbox"]["north"] == 1
    p = spark.createDataFrame([(1, "n", (1.0, 0.99, 1.0, 0.99))], f"project_id long, name string, bbox {schemas.BBOX}")
    e = spark.createDataFrame([], "project_id long, id string, type string")
    doc = json.loads(osm.analysis_document(rules.analyze(p, e, f.withColumnRenamed("area_id", "project_id"))).first().document)
    assert doc["analysis"]["provider"] == "rules" and doc["analysis"]["safety"] == ["SAFE_DEFAULT"]
    none = json.loads(spark.range(1).select(osm.bounds_geojson(F.lit(None).cast(schemas.BBOX)).alias("d")).first().d)
    assert none == {"type": "FeatureCollection", "features": []}


def test_raw_geometry_and_rendering(spark):
    at = lambda lat, lng: {"lat": lat, "lng": lng}
    rows = [(1, i, t, at(10.0, 10.0), at(10.0001, 10.0), 16.0) for i, t in enumerate(["road", "crossing", "roundabout", "signal", "odd"])]
    out = {r.type: r for r in geo.render_edits(snapping.raw_geometry(spark.createDataFrame(rows, schemas.DRAFTS))).collect()}
    assert len(out["road"].points) == 4 and not out["road"].snapped and out["road"].start is None
    assert out["crossing"].end.y == pytest.approx(out["crossing"].start.y + out["crossing"].pixel_vector.y)
    assert out["roundabout"].radius >= 12 and out["signal"]["at"] is not None and out["odd"].points is None


def test_area_box_helpers(spark):
    b = F.struct(F.lit(10.01).alias("north"), F.lit(10.0).alias("south"), F.lit(20.02).alias("east"), F.lit(20.0).alias("west"))
    r = spark.range(1).select(geo.bounds_from_box(geo.box_from_bounds(b, F.lit(15.0)), F.lit(15.0)).alias("b"), geo.bbox_area_km2(b).alias("a")).first()
    assert [round(v, 9) for v in r.b] == [10.01, 10.0, 20.02, 20.0] and 2.3 < r.a < 2.5


def test_styles(spark):
    f = spark.createDataFrame([(k,) for k in ("primary", "tertiary", "service", "cycleway", None)], "kind string")
    got = {r.kind: (r.road_width, r.road_colour) for r in features.with_road_style(f).collect()}
    assert got["primary"] == (8.0, "#2d3332") and got["tertiary"][0] == 5.0 and got["service"][0] == 3.0 and got["cycleway"] == (1.6, "#5f6866") and got[None] == (1.6, "#2d3332")


def test_no_roads_flag(spark):
    df = spark.createDataFrame([(0,), (3,)], "road_count long")
    assert [r.no_roads for r in validate.flag_no_roads(df).collect()] == [True, False]


def test_plans_push_down_and_avoid_nested_loops(spark, sf):
    plan = lambda name: queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for name in ("network_report", "network_report_drawn", "sidewalk_proximity", "nearest_segment", "nearest_vertex", "select_area", "snap_drafts"):
        text = plan(name)
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text, name
    orders = [line for line in plan("graph_edges").splitlines() if "orders.parquet" in line][0]
    assert "o_totalprice" not in orders and "IsNotNull(o_custkey)" in orders


def test_a_long_slanting_line_takes_cells_along_it_only(spark):
    """10 km at zoom 18, and the nearest segment is still found beside its middle."""
    from laneweave.operators import proximity

    way = spark.sql("select 1L as project_id, 7L as feature_id, 7L as feature_seq, 0 as segment_index, named_struct('lat', 50D, 'lng', 8D) as a, named_struct('lat', 50.064D, 'lng', 8.1D) as b")
    zero = F.lit(0.0)
    a, b = geo.to_pixel(F.col("a"), zero), geo.to_pixel(F.col("b"), zero)
    cells = way.select(F.size(proximity._line_cells(a["x"], a["y"], b["x"], b["y"], F.lit(34.0 / 2**18)))).first()[0]
    assert cells < 3_000
    points = spark.sql("select 1L as project_id, id as point_id, named_struct('lat', 50D + 0.064D * id / 100 + 0.00002D, 'lng', 8D + 0.1D * id / 100) as p, 18D as zoom from range(1, 100)")
    got = proximity.nearest_segment(points, way).collect()
    assert len(got) == 99 and all(r.feature_id == 7 and r.distance < 10 for r in got)


def test_white_space_of_all_kinds_is_blank(spark):
    rows = [(1, " \t\n\u00a0\u3000", "[]", "a"), (2, "\t A\u2003b \n", "\n {}", ""), (3, "x", "{} y", "p")]
    df = spark.createDataFrame(rows, "seq int, name string, osm_data string, id string").withColumns({"user_edits": F.lit("[1]"), "bbox": F.expr("named_struct('north', 1D, 'south', 0D, 'east', 1D, 'west', 0D)")})
    got = {r.seq: (r.name, r.id, r.reject_reason) for r in validate.save_reject_reason(df).collect()}
    assert got == {1: ("", "a", "NO_NAME"), 2: ("A\u2003b", None, None), 3: ("x", "p", "NO_OSM_DATA")}


def test_documents_have_their_types(spark):
    good = '{"bbox":{"north":1},"counts":{"roads":0},"buildings":[{"id":1.5,"kind":"x","geometry":[]}],"roads":[],"openLand":[]}'
    bad = [good.replace("1.5", '"1"'), good.replace('"x"', "1"), good.replace('"geometry":[]', '"geometry":{}'), good.replace('"roads":[],', ""), good.replace('{"north":1}', "null"), "{", None, "[]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate([good, "\n" + good, *bad])], "i int, d string")
    assert [r.ok for r in df.select("i", validate.json_document_is_valid(F.col("d")).alias("ok")).orderBy("i").collect()] == [True, True] + [False] * len(bad)


def test_paths_are_never_cut_short(spark):
    labels = spark.sql("select 1L as route_id, 1L as project_id, id as node, case when id > 0 then id - 1 end as pred, double(id) as distance_m from range(8)")
    target = spark.sql("select 1L as route_id, 1L as project_id, 7L as node")
    assert routing.route_paths(labels, target).count() == 8
    with pytest.raises(RuntimeError):
        routing.route_paths(labels, target, max_hops=3)


def test_graph_size_decides_what_is_affected(spark):
    of = lambda rows: spark.createDataFrame(rows, "project_id long, nodes long, edges long")
    got = edits.affected_projects(of([(1, 4, 3), (2, 4, 3), (3, 1, 1), (5, 2, 2)]), of([(1, 4, 3), (2, 4, 4), (4, 1, 1), (5, 2, 2)]))
    assert {r.project_id for r in got.collect()} == {2, 3, 4}
