"""From elements to classified features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import fit_canvas, flat_points
from .validate import is_way

# Stroke width and colour of road kinds on a drawn map.
ROAD_WIDTHS = {8.0: "motorway trunk primary", 5.0: "secondary tertiary", 3.0: "residential unclassified service"}
OTHER_WIDTH = 1.6
SOFT_COLOUR, DARK_COLOUR = "#5f6866", "#2d3332"
SOFT_KINDS = "footway path pedestrian cycleway"


def rename_lng(geometry: Column) -> Column:
    return F.transform(geometry, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lng")))


def classify(elements: DataFrame) -> DataFrame:
    """Features of ways with a geometry: building before road before open land.

    A tag counts when it is not empty. The kind of open land is its landuse,
    even an empty one, else its leisure. Other elements are dropped.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    has = lambda k: F.coalesce(tag(k), F.lit("")) != ""
    kind_of = F.when(has("building"), "building").when(has("highway"), "road").when(has("landuse") | has("leisure"), "open_land")
    kind = F.when(has("building"), tag("building")).when(has("highway"), tag("highway")).otherwise(F.coalesce(tag("landuse"), tag("leisure")))
    ways = elements.where(is_way(F.col("type"), F.col("geometry"))).withColumns({"feature_class": kind_of, "kind": kind, "geometry": rename_lng(F.col("geometry"))})
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return ways.where("feature_class is not null").withColumn("tags", F.coalesce("tags", empty)).withColumnsRenamed({"id": "feature_id", "element_seq": "feature_seq"}).drop("type")


def count_classes(features: DataFrame, by: str = "area_id") -> DataFrame:
    n = lambda c: F.count_if(F.col("feature_class") == c)
    return features.groupBy(by).agg(n("building").alias("building_count"), n("road").alias("road_count"), n("open_land").alias("open_land_count"))


def with_road_style(features: DataFrame) -> DataFrame:
    """Stroke width and colour of each feature's kind, from a fixed table of a dozen rows."""
    rows = [(k, w) for w, kinds in ROAD_WIDTHS.items() for k in kinds.split()]
    widths = features.sparkSession.createDataFrame(rows, "kind string, __width double")
    soft = F.col("kind").isin(*SOFT_KINDS.split())
    styled = features.join(F.broadcast(widths), "kind", "left")
    return styled.withColumns({"road_width": F.coalesce("__width", F.lit(OTHER_WIDTH)), "road_colour": F.when(soft, SOFT_COLOUR).otherwise(DARK_COLOUR)}).drop("__width")


def project_features(features: DataFrame, areas: DataFrame, w: int = 1200, h: int = 820, pad: int = 56) -> DataFrame:
    """Features with ``points``, flat canvas coordinates in their area's box."""
    box = areas.select("area_id", F.struct("north", "south", "east", "west").alias("__box"))
    return features.join(box, "area_id").withColumn("points", flat_points(F.col("geometry"), lambda p: fit_canvas(p, F.col("__box"), w, h, pad))).drop("__box")


def flatten_document(doc: DataFrame, key: str = "area_id") -> DataFrame:
    """Rows of features from documents with the arrays buildings, roads and open_land."""
    parts = []
    for column, name in (("buildings", "building"), ("roads", "road"), ("open_land", "open_land")):
        rows = doc.select(key, F.posexplode(column).alias("feature_seq", "f"))
        parts.append(rows.select(key, "feature_seq", F.lit(name).alias("feature_class"), F.col("f.id").alias("feature_id"), "f.kind", "f.tags", "f.geometry"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
