"""OpenStreetMap extracts and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_truthy, json_kind
from .layout import meet_areas, read_around
from .schemas import ELEMENT

#: Tag keys of which an element must have one.
TAG_KEYS = ("building", "highway", "landuse", "leisure")


def parse_responses(bodies: DataFrame, body_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(elements, quarantine) of response bodies.

    To the quarantine go, with their reason: a body that is null or not one
    JSON value from end to end (BAD_JSON), or no object (NOT_OBJECT), or has a
    remark that says something (REMARK; an empty one does not), and of the
    others each element without a whole number as id and a text as type
    (BAD_ELEMENT, with ``element_seq`` and ``element`` instead of the body).
    Elements keep their place in the body as ``element_seq``. A body without
    elements has none.
    """
    rest = [c for c in bodies.columns if c != body_col]
    body = F.col(f"`{body_col}`")
    parsed = bodies.withColumns({"__kind": json_kind(body), "__doc": F.from_json(body, "elements array<string>, remark variant")})
    reason = F.when(F.col("__kind").isNull(), "BAD_JSON").when(F.col("__kind") != "object", "NOT_OBJECT").when(is_truthy(F.col("__doc.remark")), "REMARK")
    marked = parsed.withColumn("reason", reason)
    listed = marked.where("reason is null").select(*rest, F.posexplode("__doc.elements").alias("element_seq", "element"))
    typed = F.from_json("element", "id variant, type variant")
    sound = F.coalesce((F.schema_of_variant(typed["id"]) == "BIGINT") & (F.schema_of_variant(typed["type"]) == "STRING"), F.lit(False))
    read = listed.select(*rest, "element_seq", "element", F.from_json("element", ELEMENT).alias("e"), sound.alias("__sound"))
    elements = read.where("__sound").select(*rest, "element_seq", "e.*")
    of_body = marked.where("reason is not null").select(*bodies.columns, "reason", F.when(F.col("reason") == "REMARK", F.try_variant_get("__doc.remark", "$", "string")).alias("remark"), F.lit(None).cast("int").alias("element_seq"), F.lit(None).cast("string").alias("element"))
    nothing = F.lit(None).cast("string")
    of_element = read.where("not __sound").select(*[nothing.alias(c) if c == body_col else F.col(f"`{c}`") for c in bodies.columns], F.lit("BAD_ELEMENT").alias("reason"), nothing.alias("remark"), "element_seq", "element")
    return elements, of_body.unionByName(of_element)


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Elements of all response files under a path, one document a file, and the quarantine."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return parse_responses(files)


def _crosses(p: Column, q: Column, a: Column) -> Column:
    """Does the segment p-q meet the box? Clipping by the parameter range inside each slab."""
    dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]

    def slab(start: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        t1, t2 = (low - start) / F.nullif(d, F.lit(0.0)), (high - start) / F.nullif(d, F.lit(0.0))
        inside = (start >= low) & (start <= high)
        enter = F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t1, t2))
        leave = F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(t1, t2))
        return enter, leave

    ex, lx = slab(p["lon"], dx, a["west"], a["east"])
    ey, ly = slab(p["lat"], dy, a["south"], a["north"])
    return F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0))


def select_area(elements: DataFrame, areas: DataFrame) -> DataFrame:
    """Ways with one of the four tag keys inside an area, with ``area_id``.

    Inside means that a vertex lies in the box or a segment crosses it. Boxes
    and ways meet in cells of the coarser of their two sizes (``layout``), so
    neither a box as wide as a continent nor a long way is many cells, and way
    and area meet once. Areas with a null, not a number or sides in the wrong
    order have no ways; points without two numbers are passed over; ways
    without any point are nowhere. Repeated rows of either table stay repeated.
    An element column ``area_id`` is replaced.
    """
    rest = [c for c in elements.columns if c != "area_id"]
    tagged = F.exists(F.array(*map(F.lit, TAG_KEYS)), lambda k: F.try_element_at("tags", k).isNotNull())
    ways = elements.select(*rest).where((F.col("type") == "way") & tagged)
    a = F.col("__area")
    g = F.filter("geometry", lambda p: (F.abs(p["lat"]) < float("inf")) & (F.abs(p["lon"]) < float("inf")))
    steps = F.sequence(F.lit(0), F.greatest(F.size("__g") - 2, F.lit(0)))
    at = lambda i: F.get(F.col("__g"), i)
    inside = F.exists(steps, lambda i: _crosses(at(i), F.coalesce(at(i + 1), at(i)), a))
    return meet_areas(ways, areas).withColumn("__g", g).where(inside).select("area_id", *rest)


def select_stored(spark: SparkSession, path: str, areas: DataFrame) -> DataFrame:
    """``select_area`` over elements that ``layout.write_elements`` wrote, reading what lies around the areas."""
    return select_area(read_around(spark, path, areas), areas)


def bounds_geojson(b: Column) -> Column:
    """Feature collection of a box as a polygon, or of nothing where there is none."""
    at = lambda lng, lat: F.array(b[lng], b[lat])
    ring = F.array(at("west", "north"), at("east", "north"), at("east", "south"), at("west", "south"), at("west", "north"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.from_json(F.lit("{}"), "map<string,string>").alias("properties"), geometry.alias("geometry"))
    full = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    return F.when(b.isNull(), '{"type":"FeatureCollection","features":[]}').otherwise(full)


def area_document(features: DataFrame, areas: DataFrame) -> DataFrame:
    """(area_id, document): box, counts and the three feature arrays of an area, as JSON.

    For single areas on their way out; the flat features table is the form to
    work on.
    """
    one = F.struct(F.col("feature_id").alias("id"), "kind", "tags", "geometry")
    in_order = lambda x, y: F.when(x["feature_seq"] < y["feature_seq"], -1).when(x["feature_seq"] > y["feature_seq"], 1).otherwise(0)
    keyed = features.groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("feature_seq", "feature_class", one.alias("f"))), in_order).alias("all"))
    of = lambda name: F.transform(F.filter(F.coalesce("all", F.expr("array()").cast(keyed.schema["all"].dataType)), lambda r: r["feature_class"] == name), lambda r: r["f"])
    joined = areas.join(keyed, "area_id", "left").withColumns({"buildings": of("building"), "roads": of("road"), "open_land": of("open_land")})
    counts = F.struct(F.size("buildings").alias("buildings"), F.size("roads").alias("roads"), F.size("open_land").alias("openLand"))
    body = F.struct(F.struct("north", "south", "east", "west").alias("bbox"), counts.alias("counts"), "buildings", "roads", F.col("open_land").alias("openLand"))
    return joined.select("area_id", F.to_json(body).alias("document"))


def analysis_document(analysis: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, document): an analysis row as JSON under the name ``analysis``."""
    rest = [c for c in analysis.columns if c != key]
    return analysis.select(key, F.to_json(F.struct(F.struct(*rest).alias("analysis"))).alias("document"))
