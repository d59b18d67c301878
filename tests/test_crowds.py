import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laneweave.operators import crowds, proximity, snapping
from laneweave.sources import schemas

POINTS = f"project_id bigint, point_id bigint, p {schemas.POINT}, zoom double"
SEGMENTS = f"project_id bigint, feature_id bigint, feature_seq int, segment_index int, a {schemas.POINT}, b {schemas.POINT}"
ROADS = f"project_id bigint, feature_id bigint, feature_seq int, geometry array<{schemas.POINT}>"


def world(lat, lng, zoom):
    size = 512 * 2.0**zoom
    return size * (lng + 180) / 360, size * (0.5 - np.log(np.tan(math.pi / 4 + np.radians(lat) / 2)) / (2 * math.pi))


@pytest.fixture
def streets(spark):
    """Points and segments of three projects, in clumps of very different density, some repeated, some long."""
    rng = random.Random(5)
    near = lambda c, w: (c[0] + rng.uniform(-w, w), c[1] + rng.uniform(-w, w))
    centres = [(1, (0.0, 0.0), 0.002), (1, (0.001, 0.001), 0.00002), (2, (60.0, 20.0), 0.0005), (3, (-45.0, 179.0), 0.01)]
    segments = []
    for i in range(900):
        project, c, w = rng.choice(centres)
        a = near(c, w)
        segments.append((project, i, i, i % 3, a, near(a, rng.choice([0.0, w / 20, w])) if i % 7 else a))
    segments += [(p, f + 1000, s + 1000, k, a, b) for p, f, s, k, a, b in segments[::5]]
    points = [(project, j, near(c, w * rng.choice([0.5, 1.5])), rng.choice([15.0, 16.5, 18.0])) for j, (project, c, w) in enumerate(rng.choice(centres) for _ in range(400))]
    points += [(9, 500, (0.0, 0.0), 16.0), (1, 501, None, 16.0), (1, 502, (0.0, 0.0), None), (None, 503, (0.0, 0.0), 16.0), (*points[0],)]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(segments, SEGMENTS)


def test_divided_cells_change_nothing(spark, streets, monkeypatch):
    points, segments = streets
    roads = segments.select("project_id", "feature_id", "feature_seq", F.array("a", "b").alias("geometry"))

    def all_of(crowd, deepest=6):
        monkeypatch.setattr(crowds, "CROWD", crowd)
        monkeypatch.setattr(crowds, "DEEPEST", deepest)
        return [sorted(map(str, df.collect())) for df in (proximity.nearest_segment(points, segments), proximity.nearest_vertex(points, roads))]

    plain = all_of(10**9)
    assert len(plain[0]) == 405 and sum("feature_id=None" not in r for r in plain[0]) > 150
    assert all_of(3) == plain and all_of(1, 2) == plain


def test_no_points_or_no_segments(spark, streets, monkeypatch):
    monkeypatch.setattr(crowds, "CROWD", 3)
    points, segments = streets
    assert proximity.nearest_segment(points.limit(0), segments).count() == 0
    assert proximity.nearest_segment(points, segments.limit(0)).where("distance is not null").count() == 0


def test_fifty_thousand_in_one_cell(spark, monkeypatch):
    """Points among the segments, and points that stand a little off all of them."""
    monkeypatch.setattr(crowds, "CROWD", 256)
    rng = np.random.default_rng(3)
    n, zoom = 50_000, 16.0
    width = 20 * 360 / (512 * 2**zoom)  # 20 pixels
    lat, lng = rng.uniform(0, width, n) + 1.0, rng.uniform(0, width, n) + 1.0
    to = rng.uniform(-width / 200, width / 200, (2, n))
    plat, plng = rng.uniform(0, width, n) + 1.0, rng.uniform(0, width, n) + 1.0
    plng[::2] += 1.4 * width
    frame = lambda columns, schema: spark.createDataFrame(list(zip(*[c.tolist() for c in columns], strict=True)), schema)
    ids = np.arange(n)
    segments = frame((ids, lat, lng, lat + to[0], lng + to[1]), "i bigint, y double, x double, y2 double, x2 double").selectExpr("1L as project_id", "i as feature_id", "cast(i as int) as feature_seq", "0 as segment_index", "named_struct('lat', y, 'lng', x) as a", "named_struct('lat', y2, 'lng', x2) as b")
    points = frame((ids, plat, plng), "i bigint, y double, x double").selectExpr("1L as project_id", "i as point_id", "named_struct('lat', y, 'lng', x) as p", f"{zoom}D as zoom")
    met = proximity.nearest_segment(points.repartition(8), segments.repartition(8))
    got = {r.point_id: (r.feature_id, r.distance) for r in met.select("point_id", "feature_id", "distance").collect()}
    assert len(got) == n
    (ax, ay), (bx, by) = world(lat, lng, zoom), world(lat + to[0], lng + to[1], zoom)
    px, py = world(plat, plng, zoom)
    for i in range(0, 400):
        dx, dy = bx - ax, by - ay
        t = np.clip(((px[i] - ax) * dx + (py[i] - ay) * dy) / (dx * dx + dy * dy), 0, 1)
        away = np.hypot(ax + t * dx - px[i], ay + t * dy - py[i])
        best = int(away.argmin())
        if away[best] <= 33.9:
            assert got[i][0] == best and abs(got[i][1] - away[best]) < 1e-6, (i, got[i], best, away[best])
        elif away[best] > 34.1:
            assert got[i] == (None, None)


def test_few_candidates_are_met(spark):
    """Points asked often, candidates repeated, and thousands of others in one cell that is not full."""
    at = lambda n, seed: [(1, i, 1.0 + 0.0002 * x, 1.0 + 0.0002 * y) for i, (x, y) in enumerate(np.random.default_rng(seed).uniform(0, 1, (n, 2)).tolist())]
    names = "project_id bigint, point_id bigint, lat double, lng double"
    asked = spark.createDataFrame(at(300, 1), names).crossJoin(spark.range(4).withColumnRenamed("id", "r"))
    points = asked.selectExpr("project_id", "point_id + r * 1000 as point_id", "named_struct('lat', lat, 'lng', lng) as p", "16D as zoom")
    places = spark.createDataFrame(at(2000, 2), names).crossJoin(spark.range(3).withColumnRenamed("id", "r"))
    roads = places.selectExpr("project_id", "point_id + r * 10000 as feature_id", "point_id + r * 10000 as feature_seq", "array(named_struct('lat', lat, 'lng', lng)) as geometry")
    zero = F.lit(0.0)
    held = roads.select("project_id", "feature_seq", proximity.to_pixel(F.col("geometry")[0], zero).alias("w")).select("project_id", "feature_seq", *[F.col(c).alias(n) for c, n in (("w.x", "__ax"), ("w.y", "__ay"), ("w.x", "__bx"), ("w.y", "__by"))])
    assert proximity._meet(points, held, 44.0, ["feature_seq"]).count() <= 2 * 300
    got = proximity.nearest_vertex(points, roads).select("point_id", "feature_id", "distance").collect()
    assert len(got) == 1200
    (_, _, lat, lng), (_, _, plat, plng) = zip(*at(2000, 2), strict=True), zip(*at(300, 1), strict=True)
    (qx, qy), (x, y) = world(np.array(lat), np.array(lng), 16.0), world(np.array(plat), np.array(plng), 16.0)
    for row in got:
        k = row.point_id % 1000
        assert row.feature_id == int(np.hypot(qx - x[k], qy - y[k]).argmin())


def test_equal_roads_are_cut_once(spark, monkeypatch):
    """Of roads that repeat the first is met; lines and crossings look for segments in one search."""
    way, other = [(1.0, 1.0), (1.0, 1.001), (1.001, 1.001)], [(1.0, 1.0), (1.0, 1.001)]
    rows = [(1, f"w{seq}", seq, way) for seq in range(60, 2, -1)] + [(1, "o", 1, other), (2, "w", 9, way), (2, "n", None, way)]
    roads = spark.createDataFrame(rows, f"project_id bigint, feature_id string, feature_seq int, geometry array<{schemas.POINT}>")
    kept = sorted((r.project_id, r.feature_id, r.segment_index) for r in snapping.snap_segments(roads).collect())
    assert kept == [(1, "o", 0), (1, "w3", 0), (1, "w3", 1), (2, "n", 0), (2, "n", 1), (2, "w", 0), (2, "w", 1)]
    searches = []
    monkeypatch.setattr(snapping, "nearest_segment", lambda *a: searches.append(1) or proximity.nearest_segment(*a))
    drafts = [(1, i, tool, (1.0, 1.00005), (1.0005, 1.001), 16.0) for i, tool in enumerate(("road", "crossing", "roundabout", "signal"))]
    drafts = spark.createDataFrame(drafts, f"project_id bigint, draft_id bigint, tool string, start {schemas.POINT}, end {schemas.POINT}, zoom double")
    none = spark.createDataFrame([], f"project_id bigint, edit_seq bigint, id string, type string, center {schemas.POINT}, pixel_radius double, zoom double")
    got = {r.type: r for r in snapping.snap_all(drafts, roads, none).collect()}
    assert len(searches) == 1 and len(got) == 4 and got["roundabout"].center == (1.0, 1.0)
    assert not got["road"].snapped  # the start is on the first road, which ends before the end
