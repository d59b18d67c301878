"""Conflation of drafted geometry with nearby streets.

Drafts are (project_id, draft_id, tool, start, end, zoom); results have the
columns of edits, so that drafts become edits in one step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import dist, from_pixel, midpoint, pixel, to_pixel, unit, vector
from ..sources.schemas import PIXEL, POINT
from ..sources.scratch import written
from .graph import explode_segments
from .proximity import first_of_equal, nearest_ring_point, nearest_segment, nearest_vertex
from .validate import is_snappable

LINE_TOOLS = ("road", "bike", "sidewalk")
MIN_CROSSING_PX, MIN_RADIUS_PX, RING_POINTS = 30.0, 12.0, 8


def path_between(geometry: Column, start_snap: Column, end_snap: Column) -> Column:
    """Points along one way from snap to snap (structs of map_point and segment_index), either direction."""
    i, j = start_snap["segment_index"], end_snap["segment_index"]
    ahead = F.slice(geometry, i + 2, F.greatest(j - i, F.lit(0)))
    back = F.reverse(F.slice(geometry, j + 2, F.greatest(i - j, F.lit(0))))
    return F.concat(F.array(start_snap["map_point"]), F.when(i <= j, ahead).otherwise(back), F.array(end_snap["map_point"]))


def roundabout_ring(edits: DataFrame) -> DataFrame:
    """Eight points around every roundabout: project_id, edit_seq, id, ring_index, map_point."""
    centre = to_pixel(F.col("center"), F.col("zoom"))
    angle = F.col("ring_index") * (2 * math.pi / RING_POINTS)
    at = pixel(centre["x"] + F.cos(angle) * F.col("pixel_radius"), centre["y"] + F.sin(angle) * F.col("pixel_radius"))
    rows = edits.where("type = 'roundabout'").withColumn("ring_index", F.explode(F.sequence(F.lit(0), F.lit(RING_POINTS - 1))))
    return rows.select("project_id", "edit_seq", "id", "ring_index", from_pixel(at, F.col("zoom")).alias("map_point"))


def _snappable(roads: DataFrame) -> DataFrame:
    """Every road with two points, whatever its kind; of those that repeat the first."""
    return first_of_equal(roads.where(is_snappable(F.col("geometry"))))


def snap_segments(roads: DataFrame) -> DataFrame:
    """Segments that drafts snap to: of every road with two points, whatever its kind; of roads that repeat the first's."""
    return explode_segments(_snappable(roads))


def _ends(drafts: DataFrame) -> DataFrame:
    """Both ends of lines."""
    ends = F.explode(F.array(F.struct(F.lit("start").alias("which"), F.col("start").alias("p")), F.struct(F.lit("end").alias("which"), F.col("end").alias("p"))))
    rows = drafts.where(F.col("tool").isin(*LINE_TOOLS)).select("project_id", "draft_id", "zoom", ends.alias("e"))
    return rows.select("project_id", F.struct("draft_id", "e.which").alias("point_id"), "e.p", "zoom")


def _middles(drafts: DataFrame) -> DataFrame:
    """The middle of crossings, on the screen."""
    middle = from_pixel(midpoint(to_pixel(F.col("start"), F.col("zoom")), to_pixel(F.col("end"), F.col("zoom"))), F.col("zoom"))
    return drafts.where("tool = 'crossing'").select("project_id", F.struct("draft_id", F.lit("middle").alias("which")).alias("point_id"), middle.alias("p"), "zoom")


def _side_by_side(found: DataFrame, value: Column, name: str) -> DataFrame:
    of = lambda which: F.max(F.when(F.col("point_id.which") == which, value)).alias(f"{name}_{which}")
    return found.groupBy("project_id", F.col("point_id.draft_id").alias("draft_id")).agg(of("start"), of("end"))


def _as_edit(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns of an edit; those not given are null."""
    types = {"path": f"array<{POINT}>", "snapped": "boolean", "anchor": POINT, "pixel_vector": PIXEL, "center": POINT, "pixel_radius": "double", "point": POINT}
    made = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select("project_id", "draft_id", F.col("tool").alias("type"), *made, "zoom")


def snap_lines(drafts: DataFrame, roads: DataFrame, ring: DataFrame) -> DataFrame:
    """Roads, bike lanes and sidewalks.

    A roundabout near either end takes both ends to their nearest snap and the
    line straight between them. Otherwise both ends must snap to the same road
    and the line follows it; else it stays as drawn.
    """
    kept = written(_snappable(roads), "roads")
    return _lines(drafts, kept, ring, nearest_segment(_ends(drafts), explode_segments(kept)))


def _lines(drafts: DataFrame, roads: DataFrame, ring: DataFrame, near: DataFrame) -> DataFrame:
    """Lines, from the segments that are nearest to their ends; they are of ``roads``."""
    lines = drafts.where(F.col("tool").isin(*LINE_TOOLS))
    on_ring = _side_by_side(nearest_ring_point(_ends(drafts), ring), F.col("map_point"), "ring")
    snap = F.when(F.col("distance").isNotNull(), F.struct("map_point", "segment_index", "feature_id", "feature_seq"))
    on_road = _side_by_side(near.where("point_id.which <> 'middle'"), snap, "road")
    key = ["project_id", "draft_id"]
    both = lines.join(on_ring, key, "left").join(on_road, key, "left")
    same = F.col("road_start.feature_id") == F.col("road_end.feature_id")
    ways = roads.select(F.col("project_id").alias("__project"), F.col("feature_seq").alias("__seq"), "geometry")
    found = both.join(ways, (F.col("project_id") == F.col("__project")) & (F.when(same, F.col("road_start.feature_seq")) == F.col("__seq")), "left")
    ringed = F.col("ring_start").isNotNull() | F.col("ring_end").isNotNull()
    straight = lambda a, b: F.array(a, b)
    at = lambda which: F.coalesce(f"ring_{which}", F.col(f"road_{which}.map_point"), which)
    path = (
        F.when(ringed, straight(at("start"), at("end")))
        .when(F.coalesce(same, F.lit(False)), path_between(F.col("geometry"), F.col("road_start"), F.col("road_end")))
        .otherwise(straight(F.col("start"), F.col("end")))
    )
    return _as_edit(found, path=path, snapped=ringed | F.coalesce(same, F.lit(False)))


def snap_crossings(drafts: DataFrame, roads: DataFrame) -> DataFrame:
    """Crossings turn across the road nearest to their middle, at least 30 pixels long; else as drawn."""
    return _crossings(drafts, nearest_segment(_middles(drafts), snap_segments(roads)))


def _crossings(drafts: DataFrame, near: DataFrame) -> DataFrame:
    """Crossings, from the segments that are nearest to their middles."""
    drawn = drafts.where("tool = 'crossing'").withColumns({"__s": to_pixel(F.col("start"), F.col("zoom")), "__e": to_pixel(F.col("end"), F.col("zoom"))})
    near = near.where("point_id.which = 'middle'").select("project_id", F.col("point_id.draft_id").alias("draft_id"), "px_point", "tangent")
    found = drawn.join(near, ["project_id", "draft_id"], "left")
    half = F.greatest(F.lit(MIN_CROSSING_PX), dist(F.col("__s"), F.col("__e"))) / 2
    across = unit(pixel(-F.col("tangent.y"), F.col("tangent.x")))
    shifted = lambda sign: pixel(F.col("px_point.x") + across["x"] * half * sign, F.col("px_point.y") + across["y"] * half * sign)
    snapped = F.col("px_point").isNotNull()
    start, end = F.when(snapped, shifted(-1)).otherwise(F.col("__s")), F.when(snapped, shifted(1)).otherwise(F.col("__e"))
    found = found.withColumns({"__from": start, "__to": end})
    return _as_edit(found, anchor=from_pixel(F.col("__from"), F.col("zoom")), pixel_vector=vector(F.col("__from"), F.col("__to")))


def snap_roundabouts(drafts: DataFrame, roads: DataFrame) -> DataFrame:
    """Roundabouts move to the nearest road vertex; the radius is at least 12 pixels, snapped or not."""
    drawn = drafts.where("tool = 'roundabout'")
    points = drawn.select("project_id", F.col("draft_id").alias("point_id"), F.col("start").alias("p"), "zoom")
    near = nearest_vertex(points, roads.where(is_snappable(F.col("geometry")))).select("project_id", F.col("point_id").alias("draft_id"), "map_point")
    radius = F.greatest(F.lit(MIN_RADIUS_PX), dist(to_pixel(F.col("start"), F.col("zoom")), to_pixel(F.col("end"), F.col("zoom"))))
    return _as_edit(drawn.join(near, ["project_id", "draft_id"], "left"), center=F.coalesce("map_point", "start"), pixel_radius=radius)


def place_signals(drafts: DataFrame) -> DataFrame:
    """Signals stay where they are put."""
    return _as_edit(drafts.where("tool = 'signal'"), point=F.col("start"))


def raw_geometry(drafts: DataFrame) -> DataFrame:
    """Every draft as drawn, without any snap."""
    s, e = to_pixel(F.col("start"), F.col("zoom")), to_pixel(F.col("end"), F.col("zoom"))
    of = lambda tool, c: F.when(F.col("tool") == tool, c)
    line = F.col("tool").isin(*LINE_TOOLS)
    return _as_edit(
        drafts, path=F.when(line, F.array("start", "end")), snapped=F.when(line, F.lit(False)), anchor=of("crossing", F.col("start")), pixel_vector=of("crossing", vector(s, e)),
        center=of("roundabout", F.col("start")), pixel_radius=of("roundabout", F.greatest(F.lit(MIN_RADIUS_PX), dist(s, e))), point=of("signal", F.col("start")),
    )


def snap_all(drafts: DataFrame, roads: DataFrame, edits: DataFrame) -> DataFrame:
    """All tools together: roads are read once, and lines and crossings look for segments in one search."""
    kept = written(_snappable(roads), "roads")
    near = written(nearest_segment(_ends(drafts).unionByName(_middles(drafts)), explode_segments(kept)), "snaps")
    parts = [_lines(drafts, kept, roundabout_ring(edits), near), _crossings(drafts, near), snap_roundabouts(drafts, kept), place_signals(drafts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
