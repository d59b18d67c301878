"""Geometry as column expressions: points are structs of lat and lng, pixels of x and y.

Two earth models are kept side by side, as results depend on them: haversine
on a sphere of 6,371,000 m, and 111.32 km per degree for areas and local metres.
None handles the antimeridian.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000
METRES_PER_DEGREE = 111_320
KM_PER_DEGREE = 111.32
WORLD_PIXELS = 512


def point(lat: Column, lng: Column) -> Column:
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def pixel(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def bbox_area_km2(b: Column) -> Column:
    """Approximate area of a struct of north, south, east, west."""
    height = F.abs(b["north"] - b["south"]) * KM_PER_DEGREE
    width = F.abs(b["east"] - b["west"]) * (KM_PER_DEGREE * F.cos(F.radians((b["north"] + b["south"]) / 2)))
    return width * height


def haversine_m(a: Column, b: Column) -> Column:
    half_lat, half_lng = F.radians(b["lat"] - a["lat"]) / 2, F.radians(b["lng"] - a["lng"]) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(half_lng), 2)
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def node_key(p: Column) -> Column:
    """Coordinates as whole micro-degrees, so that equal places have equal keys."""
    e6 = lambda c: (c.cast("decimal(20,7)").cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return F.struct(e6(p["lat"]).alias("lat_e6"), e6(p["lng"]).alias("lng_e6"))


def local_xy_m(p: Column, ref_lat: Column) -> Column:
    """Metres on a plane at a reference latitude in degrees."""
    return pixel(p["lng"] * METRES_PER_DEGREE * F.cos(F.radians(ref_lat)), p["lat"] * METRES_PER_DEGREE)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))


def vector(a: Column, b: Column) -> Column:
    return pixel(b["x"] - a["x"], b["y"] - a["y"])


def midpoint(a: Column, b: Column) -> Column:
    return pixel((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def unit(v: Column) -> Column:
    """Vector of length one; (1, 0) for a vector without length."""
    n = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
    return pixel(F.when(n == 0, 1.0).otherwise(v["x"] / F.nullif(n, F.lit(0.0))), F.when(n == 0, 0.0).otherwise(v["y"] / F.nullif(n, F.lit(0.0))))


def closest_on_segment(p: Column, a: Column, b: Column) -> Column:
    """struct(x, y, t, distance) of the point of a-b nearest to p; t is 0 on a segment without length."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    along = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(square, F.lit(0.0))
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    x, y = a["x"] + dx * t, a["y"] + dy * t
    return F.struct(x.alias("x"), y.alias("y"), t.alias("t"), dist(p, pixel(x, y)).alias("distance"))


def point_segment_m(p: Column, a: Column, b: Column) -> Column:
    """Metres from a point to a segment, on the plane at the mean of the three latitudes."""
    ref = (p["lat"] + a["lat"] + b["lat"]) / 3
    return closest_on_segment(local_xy_m(p, ref), local_xy_m(a, ref), local_xy_m(b, ref))["distance"]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return point(a["lat"] + (b["lat"] - a["lat"]) * t, a["lng"] + (b["lng"] - a["lng"]) * t)


def map_midpoint(a: Column, b: Column) -> Column:
    return point((a["lat"] + b["lat"]) / 2, (a["lng"] + b["lng"]) / 2)


def to_pixel(p: Column, zoom: Column) -> Column:
    """Web Mercator world pixels at a zoom (no pitch)."""
    size = F.pow(F.lit(2.0), zoom) * WORLD_PIXELS
    y = F.lit(0.5) - F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["lat"]) / 2)) / (2 * math.pi)
    return pixel(size * (p["lng"] + 180) / 360, size * y)


def from_pixel(q: Column, zoom: Column) -> Column:
    size = F.pow(F.lit(2.0), zoom) * WORLD_PIXELS
    lat = F.degrees(F.atan(F.sinh((F.lit(0.5) - q["y"] / size) * (2 * math.pi))))
    return point(lat, q["x"] / size * 360 - 180)


def fit_canvas(p: Column, b: Column, w: int = 1200, h: int = 820, pad: int = 56) -> Column:
    """Place of a point on a canvas that shows a whole box, centred, at one scale."""
    lng_span = F.greatest(b["east"] - b["west"], F.lit(1e-6))
    lat_span = F.greatest(b["north"] - b["south"], F.lit(1e-6))
    scale = F.least(F.lit(float(w - 2 * pad)) / lng_span, F.lit(float(h - 2 * pad)) / lat_span)
    x = (F.lit(float(w)) - lng_span * scale) / 2 + (p["lng"] - b["west"]) * scale
    y = (F.lit(float(h)) - lat_span * scale) / 2 + (b["north"] - p["lat"]) * scale
    return pixel(x, y)


def flat_points(geometry: Column, project: Callable[[Column], Column]) -> Column:
    """Array x1, y1, x2, y2 and so on of projected points."""

    def pair(p: Column) -> Column:
        q = project(p)
        return F.array(q["x"], q["y"])

    return F.flatten(F.transform(geometry, pair))


def box_from_corners(p: Column, q: Column) -> Column:
    return F.struct(
        F.least(p["x"], q["x"]).alias("left"), F.least(p["y"], q["y"]).alias("top"), F.abs(q["x"] - p["x"]).alias("width"), F.abs(q["y"] - p["y"]).alias("height")
    )


def bounds_from_box(box: Column, zoom: Column) -> Column:
    a = from_pixel(pixel(box["left"], box["top"]), zoom)
    b = from_pixel(pixel(box["left"] + box["width"], box["top"] + box["height"]), zoom)
    return F.struct(
        F.greatest(a["lat"], b["lat"]).alias("north"), F.least(a["lat"], b["lat"]).alias("south"), F.greatest(a["lng"], b["lng"]).alias("east"), F.least(a["lng"], b["lng"]).alias("west")
    )


def box_from_bounds(b: Column, zoom: Column) -> Column:
    return box_from_corners(to_pixel(point(b["north"], b["west"]), zoom), to_pixel(point(b["south"], b["east"]), zoom))


def segment_metrics(a: Column, b: Column, min_len: float = 26) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.struct(F.degrees(F.atan2(dy, dx)).alias("angle"), F.greatest(F.lit(float(min_len)), dist(a, b)).alias("length"), midpoint(a, b).alias("midpoint"))


def any_within(p: Column, path: Column, metres: float) -> Column:
    """Is a point within ``metres`` of any segment of one path?"""
    steps = F.when(F.size(path) >= 2, F.sequence(F.lit(0), F.size(path) - 2)).otherwise(F.expr("array()").cast("array<int>"))
    return F.exists(steps, lambda i: point_segment_m(p, F.get(path, i), F.get(path, i + 1)) <= metres)


def render_edits(edits: DataFrame) -> DataFrame:
    """Edits with their places in world pixels at their zoom.

    ``points`` for lines, ``start`` and ``end`` for crossings, ``centre`` and
    ``radius`` for roundabouts, ``at`` for signals; the others are null. Sizes
    in pixels do not change with the zoom.
    """
    zoom = F.col("zoom")
    of = lambda kind, c: F.when(F.col("type") == kind, c)
    start = to_pixel(F.col("anchor"), zoom)
    line = F.col("type").isin("road", "bike", "sidewalk")
    return edits.withColumns(
        {
            "points": F.when(line, flat_points(F.col("path"), lambda p: to_pixel(p, zoom))),
            "start": of("crossing", start),
            "end": of("crossing", pixel(start["x"] + F.col("pixel_vector.x"), start["y"] + F.col("pixel_vector.y"))),
            "centre": of("roundabout", to_pixel(F.col("center"), zoom)),
            "radius": of("roundabout", F.col("pixel_radius")),
            "at": of("signal", to_pixel(F.col("point"), zoom)),
        }
    )
