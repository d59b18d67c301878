"""Distance joins through grids of cells.

A join on distance alone would compare everything with everything. Here both
sides meet by equal cells whose edge is no shorter than the cutoff, and the
exact distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, closest_on_segment, dist, lerp, pixel, point, to_pixel, unit, vector
from .crowds import line_cells as _line_cells
from .crowds import meet

# Cutoffs in pixels, and in metres.
SEGMENT_PX, VERTEX_PX, RING_PX, NODE_PX, SIDEWALK_M = 34.0, 44.0, 46.0, 42.0, 18.0


def _row(lat: Column, cell: float) -> Column:
    return F.floor(lat * METRES_PER_DEGREE / cell)


def _column(lng: Column, row: Column, cell: float) -> Column:
    """Cells get more degrees wide towards the poles; all of one row are alike."""
    south = row * (cell / METRES_PER_DEGREE)
    far = F.least(F.greatest(F.abs(south), F.abs(south + cell / METRES_PER_DEGREE)), F.lit(89.9))
    return F.floor(lng * METRES_PER_DEGREE * F.cos(F.radians(far)) / cell)


def within_distance(points: DataFrame, segments: DataFrame, metres: float = SIDEWALK_M, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Rows of ``points`` (with ``p``) that a segment (``a``, ``b``) of the same keys is within ``metres`` of.

    Rows come out as often as they are there, however many segments are near. A
    point lies in one cell; a segment, widened by the cutoff, in all that it
    covers. Each place and each segment is met once, however often it is there.
    """
    asked = points.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("p.lat").alias("__lat"), F.col("p.lng").alias("__lng"))
    places = asked.distinct().select("*", point(F.col("__lat"), F.col("__lng")).alias("p"))
    segments = segments.select(*keys, point(F.col("a.lat"), F.col("a.lng")).alias("a"), point(F.col("b.lat"), F.col("b.lng")).alias("b")).distinct()
    cell = max(4 * metres, 50.0)
    reach = metres * 1.01 / METRES_PER_DEGREE
    a, b = F.col("a"), F.col("b")
    far = F.least(F.greatest(F.abs(a["lat"]), F.abs(b["lat"])) + reach, F.lit(89.9))
    wide = F.lit(reach) / F.cos(F.radians(far))
    box = [F.least(a["lat"], b["lat"]) - reach, F.greatest(a["lat"], b["lat"]) + reach, F.least(a["lng"], b["lng"]) - wide, F.greatest(a["lng"], b["lng"]) + wide]
    boxed = segments.select(*[F.col(k).alias(f"__{k}") for k in keys], "a", "b", *[c.alias(n) for c, n in zip(box, ("__south", "__north", "__west", "__east"), strict=True)])
    cells = F.flatten(
        F.transform(
            F.sequence(_row(F.col("__south"), cell), _row(F.col("__north"), cell)),
            lambda r: F.transform(F.sequence(_column(F.col("__west"), r, cell), _column(F.col("__east"), r, cell)), lambda c: F.struct(r.alias("row"), c.alias("col"))),
        )
    )
    held = boxed.withColumn("__cell", F.explode(cells))
    row = _row(F.col("p.lat"), cell)
    placed = places.withColumn("__at", F.struct(row.alias("row"), _column(F.col("p.lng"), row, cell).alias("col")))
    on = (F.col("__at") == F.col("__cell")) & F.col("__lat").between(F.col("__south"), F.col("__north")) & F.col("__lng").between(F.col("__west"), F.col("__east"))
    for k in keys:
        on &= F.col(f"__of_{k}") == F.col(f"__{k}")
    asked = [*[f"__of_{k}" for k in keys], "__lat", "__lng"]
    met = placed.join(held, on).select(*asked, "p", "a", "b", F.cos(F.radians((F.col("p.lat") + F.col("a.lat") + F.col("b.lat")) / 3)).alias("__cos"))
    # As point_segment_m has it, step by step: one expression, or the condition of a join, computes the cosine for every coordinate again.
    flat = met.select(*asked, *[c.alias(f"__{v}{n}") for v in "pab" for n, c in (("x", F.col(f"{v}.lng") * METRES_PER_DEGREE * F.col("__cos")), ("y", F.col(f"{v}.lat") * METRES_PER_DEGREE))])
    at = lambda v: pixel(F.col(f"__{v}x"), F.col(f"__{v}y"))
    near = flat.groupBy(*asked).agg(F.min(closest_on_segment(at("p"), at("a"), at("b"))["distance"]).alias("__m")).where(F.col("__m") <= metres)
    same = (F.col("p.lat") == F.col("__lat")) & (F.col("p.lng") == F.col("__lng"))
    for k in keys:
        same &= F.col(k) == F.col(f"__of_{k}")
    return points.join(near, same, "left_semi")


def nearest_one(candidates: DataFrame, by: list[str], order: list[str], value: list[str]) -> DataFrame:
    """For each ``by`` the candidate that is first in ``order``."""
    best = F.min_by(F.struct(*value), F.struct(*order)).alias("__best")
    return candidates.groupBy(*by).agg(best).select(*by, *[F.col(f"__best.{v}").alias(v) for v in value])


_ASKED = ["project_id", "__lat", "__lng", "__zoom"]


def _meet(points: DataFrame, candidates: DataFrame, px: float, order: list[str]) -> DataFrame:
    """Places and zooms of points (``_ASKED``), each asked once, joined with the candidates of the project that may be nearest.

    A candidate has its ends in world pixels at zoom 0 (__ax, __ay, __bx,
    __by); points get theirs (__wx, __wy) and the scale of their zoom, so that
    no pair projects anything. Cells are ``px`` wide at the whole zoom level
    below a point's own, so at its zoom they are at least as wide as the
    cutoff. Of candidates with equal ends the first by ``order`` is met.
    """
    asks = points.select("project_id", F.col("p.lat").alias("__lat"), F.col("p.lng").alias("__lng"), F.col("zoom").alias("__zoom")).distinct()
    world = to_pixel(point(F.col("__lat"), F.col("__lng")), F.lit(0.0))
    asks = asks.withColumns({"level": F.floor("__zoom").cast("int"), "__w": world, "__scale": F.pow(F.lit(2.0), F.col("__zoom"))})
    asks = asks.select(*_ASKED, "level", F.col("__w.x").alias("__wx"), F.col("__w.y").alias("__wy"), "__scale", (F.lit(px * 1.000001) / F.col("__scale")).alias("__reach"))
    sound = F.col("__wx").between(-1e300, 1e300) & F.col("__wy").between(-1e300, 1e300) & F.col("__scale").between(1e-300, 1e300)
    return meet(asks.where(sound & F.col("project_id").isNotNull()), candidates, px, order)


def _answered(points: DataFrame, best: DataFrame, value: list[str]) -> DataFrame:
    """All points, those of one place and zoom with the same answer."""
    found = best.withColumnRenamed("project_id", "__project")
    on = (F.col("project_id") == F.col("__project")) & (F.col("p.lat") == F.col("__lat")) & (F.col("p.lng") == F.col("__lng")) & (F.col("zoom") == F.col("__zoom"))
    key = ["project_id", "point_id"]
    return points.join(found, on, "left").select(*key, *[c for c in points.columns if c not in key], *value)


def first_of_equal(roads: DataFrame) -> DataFrame:
    """Of the roads of a project with equal geometry the first (feature_seq): no other is ever the nearest.

    Its number and identifier are kept beside the geometry by hashing: rows
    that repeat are neither sorted nor cut into segments.
    """
    null = F.col("feature_seq").isNull().alias("__null")
    identifier = F.coalesce(F.min_by("feature_id", "feature_seq"), F.min("feature_id")).alias("feature_id")
    return roads.groupBy("project_id", "geometry", null).agg(F.min("feature_seq").alias("feature_seq"), identifier).select("project_id", "feature_id", "feature_seq", "geometry")


_SEGMENT = ["distance", "map_point", "px_point", "tangent", "feature_id", "feature_seq", "segment_index"]


def nearest_segment(points: DataFrame, segments: DataFrame, px: float = SEGMENT_PX) -> DataFrame:
    """Nearest road segment of every point, nulls where none is within ``px`` pixels.

    ``points`` has project_id, point_id, p and zoom; ``segments`` project_id,
    feature_id, feature_seq, segment_index, a and b. Of equally near ones the
    first in (feature_seq, segment_index) wins. A null place, zoom or project
    finds nothing; rows come out one for one; an empty table finds nothing.
    Columns of ``points`` named as the result's are ambiguous and not allowed.
    """
    zero = F.lit(0.0)
    held = segments.select("project_id", "feature_id", "feature_seq", "segment_index", "a", "b", to_pixel(F.col("a"), zero).alias("__a"), to_pixel(F.col("b"), zero).alias("__b"))
    held = held.select("*", F.col("__a.x").alias("__ax"), F.col("__a.y").alias("__ay"), F.col("__b.x").alias("__bx"), F.col("__b.y").alias("__by")).drop("__a", "__b")
    met = _meet(points, held, px, ["feature_seq", "segment_index"])
    at = lambda c: pixel(F.col(f"__{c}x") * F.col("__scale"), F.col(f"__{c}y") * F.col("__scale"))
    met = met.withColumn("__c", closest_on_segment(at("w"), at("a"), at("b"))).where(F.col("__c.distance") <= px)
    met = met.withColumns({"distance": F.col("__c.distance"), "map_point": lerp(F.col("a"), F.col("b"), F.col("__c.t")), "px_point": pixel(F.col("__c.x"), F.col("__c.y")), "tangent": unit(vector(at("a"), at("b")))})
    best = nearest_one(met, _ASKED, ["distance", "feature_seq", "segment_index"], _SEGMENT)
    return _answered(points, best, _SEGMENT)


def _nearest_place(points: DataFrame, places: DataFrame, px: float, order: list[str], value: list[str]) -> DataFrame:
    held = places.withColumn("__p", to_pixel(F.col("place"), F.lit(0.0)))
    held = held.withColumns({"__ax": F.col("__p.x"), "__ay": F.col("__p.y"), "__bx": F.col("__p.x"), "__by": F.col("__p.y")}).drop("__p")
    met = _meet(points, held, px, order).withColumn("px_point", pixel(F.col("__ax") * F.col("__scale"), F.col("__ay") * F.col("__scale")))
    met = met.withColumn("distance", dist(pixel(F.col("__wx") * F.col("__scale"), F.col("__wy") * F.col("__scale")), F.col("px_point")))
    value = ["distance", "px_point", *value]
    return _answered(points, nearest_one(met.where(F.col("distance") <= px), _ASKED, ["distance", *order], value), value)


def nearest_vertex(points: DataFrame, roads: DataFrame, px: float = VERTEX_PX) -> DataFrame:
    """Nearest vertex of a road (project_id, feature_id, feature_seq, geometry) of every point."""
    vertices = first_of_equal(roads).select("project_id", "feature_id", "feature_seq", F.posexplode("geometry").alias("vertex_index", "place")).withColumn("map_point", F.col("place"))
    return _nearest_place(points, vertices, px, ["feature_seq", "vertex_index"], ["map_point", "feature_id", "vertex_index"])


def nearest_ring_point(points: DataFrame, ring: DataFrame, px: float = RING_PX) -> DataFrame:
    """Nearest ring point (project_id, edit_seq, ring_index, id, map_point) of every point."""
    places = ring.select("project_id", "edit_seq", "ring_index", F.col("id").alias("roundabout_id"), "map_point").withColumn("place", F.col("map_point"))
    return _nearest_place(points, places, px, ["edit_seq", "ring_index"], ["map_point", "roundabout_id", "ring_index"])


def nearest_node(points: DataFrame, nodes: DataFrame, px: float = NODE_PX) -> DataFrame:
    """Nearest graph node (project_id, node, point, node_seq) of every point."""
    places = nodes.select("project_id", "node", "node_seq", F.col("point").alias("place"))
    return _nearest_place(points, places, px, ["node_seq"], ["node"])
