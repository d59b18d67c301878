"""Filters and validation. A reject reason is null for a good row; of several reasons the first counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bbox_area_km2, bounds_from_box, box_from_corners, dist, to_pixel
from ..functions.text import is_truthy, json_kind, strip

# Fixed values.
NOT_ROUTABLE = ("construction", "proposed", "abandoned", "raceway")
WALKABLE = ("footway", "path", "pedestrian", "steps", "living_street")
NO_SIDEWALK = ("", "no", "none", "separate")
_SIDES = ("north", "south", "east", "west")


def bbox_has_shape(b: Column) -> Column:
    return b.isNotNull() & b["north"].isNotNull() & b["south"].isNotNull() & b["east"].isNotNull() & b["west"].isNotNull()


def bbox_reject_reason(b: Column, max_km2: float = 5.0) -> Column:
    finite = F.lit(True)
    for side in _SIDES:
        finite &= ~F.isnan(b[side]) & (F.abs(b[side]) < float("inf"))
    return (
        F.when(~bbox_has_shape(b), "BAD_SHAPE")
        .when(~finite, "NOT_FINITE")
        .when((b["south"] >= b["north"]) | (b["west"] >= b["east"]), "BAD_ORDER")
        .when((b["north"] > 90) | (b["south"] < -90) | (b["east"] > 180) | (b["west"] < -180), "OUT_OF_RANGE")
        .when(bbox_area_km2(b) > max_km2, "TOO_LARGE")
    )


def is_way(kind: Column, geometry: Column) -> Column:
    return F.coalesce((kind == "way") & (F.size(geometry) > 0), F.lit(False))


def is_routable(kind: Column, geometry: Column) -> Column:
    return (F.size(geometry) >= 2) & ~F.coalesce(kind.isin(*NOT_ROUTABLE), F.lit(False))


def is_snappable(geometry: Column) -> Column:
    return F.size(geometry) >= 2


def keep_segments(segments: DataFrame, min_m: float = 1.0) -> DataFrame:
    """Segments of ``min_m`` metres or more whose ends are different nodes."""
    return segments.where((F.col("length_m") >= min_m) & (F.col("a_key") != F.col("b_key")))


def implies_sidewalk(kind: Column, tags: Column) -> Column:
    tag = F.coalesce(F.try_element_at(tags, F.lit("sidewalk")), F.lit(""))
    return F.coalesce(kind.isin(*WALKABLE), F.lit(False)) | ~tag.isin(*NO_SIDEWALK)


def is_edit(edit_id: Column, kind: Column) -> Column:
    return edit_id.isNotNull() & kind.isNotNull()


def is_sidewalk_path(kind: Column, path: Column) -> Column:
    return F.coalesce((kind == "sidewalk") & (F.size(path) >= 2), F.lit(False))


def _json_is(c: Column, *kinds: str) -> Column:
    return F.coalesce(json_kind(c).isin(*kinds), F.lit(False))


def save_reject_reason(requests: DataFrame) -> DataFrame:
    """Save requests with trimmed name, empty id as null, and ``reject_reason``."""
    name = strip(F.coalesce("name", F.lit("")))
    reason = (
        F.when(name == "", "NO_NAME")
        .when(~bbox_has_shape(F.col("bbox")), "BAD_BBOX")
        .when(~_json_is(F.col("osm_data"), "object", "array"), "NO_OSM_DATA")
        .when(~_json_is(F.col("user_edits"), "array"), "BAD_EDITS")
    )
    return requests.withColumns({"name": name, "id": F.nullif("id", F.lit("")), "reject_reason": reason})


def analyze_reject_reason(requests: DataFrame) -> DataFrame:
    """Analysis requests (bbox, osm_data, user_edits as JSON) with ``reject_reason``."""
    parts = F.from_json("osm_data", "counts variant, roads variant, buildings variant, openLand variant")
    listed = lambda key: F.coalesce(F.schema_of_variant(parts[key]).startswith("ARRAY"), F.lit(False))
    sound = _json_is(F.col("osm_data"), "object") & is_truthy(parts["counts"]) & listed("roads") & listed("buildings") & listed("openLand")
    reason = (
        F.when(~bbox_has_shape(F.col("bbox")), "BAD_BBOX")
        .when(~sound, "NO_OSM_DATA")
        .when(~_json_is(F.col("user_edits"), "array"), "BAD_EDITS")
    )
    return requests.withColumn("reject_reason", reason)


def document_is_valid(features: Column) -> Column:
    """Every feature of an array has an id, a kind and a geometry; one bad feature rejects all."""
    return F.coalesce(F.forall(features, lambda f: f["id"].isNotNull() & f["kind"].isNotNull() & f["geometry"].isNotNull()), F.lit(False))


_FEATURE = "array<struct<id:variant,kind:variant,geometry:variant>>"


def json_document_is_valid(document: Column) -> Column:
    """Is a JSON document one of features: buildings, roads, openLand, with a bbox and counts?

    Every feature has a number as id, a string as kind and an array as
    geometry; one bad feature rejects the whole document, and so does text
    that is null or no JSON.
    """
    whole = F.try_parse_json(document)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(whole, path, "variant")), F.lit("VOID"))
    good = whole.isNotNull() & _json_is(document, "object")
    for name in ("buildings", "roads", "openLand"):
        features = F.try_variant_get(whole, f"$.{name}", _FEATURE)
        of = lambda f, c: F.coalesce(F.schema_of_variant(f[c]), F.lit("VOID"))
        each = F.forall(features, lambda f: of(f, "id").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (of(f, "kind") == "STRING") & of(f, "geometry").startswith("ARRAY"))
        good &= F.startswith(kind(f"$.{name}"), F.lit("ARRAY")) & F.coalesce(each, F.lit(False))
    for name in ("bbox", "counts"):
        good &= is_truthy(F.try_variant_get(whole, f"$.{name}", "variant"))
    return F.coalesce(good, F.lit(False))


def keep_gestures(drafts: DataFrame, min_px: float = 6.0) -> DataFrame:
    """Drafts dragged over ``min_px`` pixels or more at their zoom."""
    return drafts.where(dist(to_pixel(F.col("start"), F.col("zoom")), to_pixel(F.col("end"), F.col("zoom"))) >= min_px)


def keep_boxes(boxes: DataFrame, min_px: float = 8.0, max_km2: float = 5.0) -> DataFrame:
    """Boxes (corners p and q in world pixels, zoom) that are large and small enough, with their bounds."""
    drawn = boxes.withColumn("box", box_from_corners(F.col("p"), F.col("q")))
    drawn = drawn.where((F.col("box.width") >= min_px) & (F.col("box.height") >= min_px))
    bounded = drawn.withColumn("bounds", bounds_from_box(F.col("box"), F.col("zoom")))
    return bounded.where(bbox_area_km2(F.col("bounds")) <= max_km2)


def flag_no_roads(counts: DataFrame) -> DataFrame:
    return counts.withColumn("no_roads", F.col("road_count") == 0)


