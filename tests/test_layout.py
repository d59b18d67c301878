"""Selection over a store laid out by place, and documents in pieces."""

import json
import random

import pytest
from pyspark.sql import functions as F

from laneweave.sources import chunks, layout, osm, schemas
from laneweave.sources.scratch import fresh_path

ELEMENTS = "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>, note string"


def _meets(path, box):
    """Does a line of points meet the box? A plain clip of each piece."""
    n, s, e, w = box
    for (y1, x1), (y2, x2) in zip(path, path[1:] or path):
        t0, t1, ok = 0.0, 1.0, True
        for p, d, low, high in ((x1, x2 - x1, w, e), (y1, y2 - y1, s, n)):
            if d == 0:
                ok = ok and low <= p <= high
            else:
                a, b = sorted(((low - p) / d, (high - p) / d))
                t0, t1 = max(t0, a), min(t1, b)
        if ok and t0 <= t1:
            return True
    return False


def test_stored_selection_against_a_plain_loop(spark):
    rng = random.Random(5)
    ways, boxes = [], []
    for i in range(1500):
        lat, lon, size = rng.uniform(-89, 89), rng.uniform(-179, 179), 10 ** rng.uniform(-4, 2.2)
        if i % 3 == 0:
            lat, lon = 48 + rng.uniform(0, 1), 9 + rng.uniform(0, 1)
        ways.append((i, [(max(-90.0, min(90.0, lat + rng.uniform(-size, size))), max(-180.0, min(180.0, lon + rng.uniform(-size, size)))) for _ in range(rng.randint(1, 5))]))
    ways += [(9000, [(0.0, 0.0), (0.0, 90.0)]), (9001, [(90.0, 180.0)]), (9002, [(-90.0, -180.0)]), (9003, [(5.625, 11.25), (2.8125, 5.625)]), (9004, [(95.0, 200.0), (96.0, 210.0)])]
    for a in range(60):
        lat, lon, size = rng.uniform(-80, 80), rng.uniform(-170, 170), 10 ** rng.uniform(-3, 2)
        if a % 2:
            lat, lon = 48 + rng.uniform(0, 1), 9 + rng.uniform(0, 1)
        boxes.append((a, lat + size / 2, lat - size / 2, lon + size, lon - size))
    boxes += [(900, 90.0, -90.0, 180.0, -180.0), (901, 0.0, 0.0, 0.0, 0.0), (902, 5.625, 5.625, 11.25, 11.25), (903, 60.0, 35.0, 40.0, -10.0), (904, 100.0, 94.0, 220.0, 190.0)]
    bad = [(950, None, 0.0, 1.0, 0.0), (951, 0.0, 1.0, 1.0, 0.0), (952, float("nan"), 0.0, 1.0, 0.0), (953, float("inf"), 0.0, 1.0, 0.0)]
    line = lambda path: [{"lat": y, "lon": x} for y, x in path]
    rows = [("way", i, {"highway": "x"}, line(p), "n") for i, p in ways]
    rows += [("way", 9100, {"highway": "x"}, [], "n"), ("way", 9101, {"highway": "x"}, None, "n"), ("way", 9102, {"name": "x"}, line([(48.5, 9.5)]), "n"), ("node", 9103, {"highway": "x"}, line([(48.5, 9.5)]), "n"), ("way", 9104, None, line([(48.5, 9.5)]), "n")]
    rows += [("way", 9105, {"highway": "x"}, line([(None, 1.0), (float("nan"), 2.0)]), None)]
    df, areas = spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame(boxes + bad, schemas.AREAS)
    want = sorted((a, i) for a, *box in boxes for i, path in ways if _meets(path, box))
    assert sorted(map(tuple, osm.select_area(df, areas).select("area_id", "id").collect())) == want
    path = fresh_path(spark, "elements")
    layout.write_elements(df, path)
    got = osm.select_stored(spark, path, areas)
    assert sorted(map(tuple, got.select("area_id", "id").collect())) == want and got.columns == ["area_id", *df.columns]
    assert osm.select_stored(spark, path, areas.where("area_id >= 950")).count() == 0
    assert osm.select_area(df.where("false"), areas).count() == 0
    # Repeated rows stay, a clashing area_id is replaced.
    twice = osm.select_area(df.where("id = 9001").unionAll(df.where("id = 9001")).withColumn("area_id", F.lit(5)), areas.where("area_id = 900"))
    assert [r.area_id for r in twice.collect()] == [900, 900]


def test_a_small_box_reads_few_files_and_a_wide_one_few_cells(spark):
    at = spark.range(40000).selectExpr("'way' as type", "id", "map('highway', 'x') as tags", "array(named_struct('lat', (id div 200) * 0.2D + 31, 'lon', (id % 200) * 0.4D - 15)) as geometry")
    path = fresh_path(spark, "elements")
    layout.write_elements(at, path, files=16)
    small = spark.createDataFrame([(1, 48.9, 48.0, 9.9, 8.0)], schemas.AREAS)
    wide = spark.createDataFrame([(2, 70.0, 30.0, 60.0, -10.0)], schemas.AREAS)
    every = len(spark.read.parquet(path).inputFiles())
    near = layout.read_around(spark, path, small)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    scans = [s for s in near._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in s]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [tile#" in scans[0] and "LessThanOrEqual(box_south" in scans[0]
    read = near.select(F.input_file_name().alias("f")).distinct().count()
    assert every > 200 and len(layout.tiles_of(small)) < 60 and read <= 8
    want = at.where("geometry[0].lat between 30 and 70 and geometry[0].lon between -10 and 60").count()
    assert osm.select_stored(spark, path, wide).count() == want
    assert len(layout.tiles_of(wide)) < 600
    cells = layout.area_boxes(wide).select(F.size(layout._around(F.col("__area"), F.col("__level")))).first()[0]
    assert cells <= 9
    with pytest.raises(ValueError, match="place"):
        layout.write_elements(at.withColumn("Place", F.lit(1)), path)


def test_pieces_put_together_are_the_document(spark):
    rows = [(1, i, ("building", "road", "open_land", "odd")[i % 4], i, "k" * (i % 50), {"n": "ä中" * (i % 7)}, [(1.0, float(i))]) for i in range(3000)]
    rows += [(1, 5000, "road", 7, None, None, None), (1, None, "road", 8, "x", {}, []), (1, 1, "road", 1, "y", {}, []), (1, 1, "road", 1, "y", {}, []), (3, 0, "road", 1, "gone", {}, [])]
    f = spark.createDataFrame(rows, schemas.FEATURES).withColumn("chunk", F.lit("clash"))
    areas = spark.createDataFrame([(1, 1.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, None, 0.0), (2, 1.0, 0.0, None, 0.0)], schemas.AREAS)
    got = chunks.document_chunks(f, areas, 8192)
    docs = {}
    for r in got.orderBy("area_id", "chunk").collect():
        assert len(r.document.encode()) <= 8192
        docs.setdefault(r.area_id, []).append(json.loads(r.document))
    assert set(docs) == {1, 2} and len(docs[1]) > 20 and len(docs[2]) == 1
    whole = {r.area_id: json.loads(r.document) for r in osm.area_document(f.where("feature_class <> 'odd' and feature_seq is not null and not (feature_seq = 1 and kind = 'y')"), areas.limit(1)).collect()}[1]
    joined = {n: [x for d in docs[1] for x in d[n]] for n in ("buildings", "roads", "openLand")}
    assert joined["roads"][0]["id"] == 8 and sum(x.get("kind") == "y" for x in joined["roads"]) == 2
    assert [x for x in joined["roads"] if x["id"] != 8 and x.get("kind") != "y"] == whole["roads"]
    assert joined["buildings"] == whole["buildings"] and joined["openLand"] == whole["openLand"] and docs[1][0]["bbox"] == whole["bbox"]
    assert docs[1][0]["counts"] == {"buildings": 750, "roads": 754, "openLand": 750} and "counts" not in docs[1][1]
    assert docs[2][0]["counts"] == {"buildings": 0, "roads": 0, "openLand": 0} and docs[2][0]["roads"] == []
    back = chunks.chunk_features(got)
    assert back.count() == 2254 and back.where("feature_class = 'road'").count() == 754
    assert chunks.chunk_features(spark.createDataFrame([(1, 0, None), (1, 1, "{x")], "area_id long, chunk long, document string")).count() == 0
    assert chunks.document_chunks(f.where("false"), areas.where("false")).count() == 0
    # One feature above the bound is a piece of its own.
    long = spark.createDataFrame([(1, 0, "road", 1, "k" * 20000, {}, []), (1, 1, "road", 2, "k", {}, [])], schemas.FEATURES)
    assert [r.chunk for r in chunks.document_chunks(long, areas, 8192).where("area_id = 1").orderBy("chunk").collect()] == [0, 5]
