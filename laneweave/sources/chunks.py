"""Documents of areas in numbered pieces of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schemas import POINT

#: Feature classes in the order of a document, with the names of their arrays.
CLASSES = {"building": "buildings", "road": "roads", "open_land": "openLand"}

#: Sequence numbers of a stretch, inside which bytes are added up one by one.
STRETCH = 1024

ITEMS = f"array<struct<id:bigint,kind:string,tags:map<string,string>,geometry:array<{POINT}>>>"
PIECE = "bbox struct<north:double,south:double,east:double,west:double>, counts struct<buildings:bigint,roads:bigint,openLand:bigint>, " + ", ".join(f"{n} {ITEMS}" for n in CLASSES.values())


def _placed(features: DataFrame) -> DataFrame:
    """(area_id, cls, at, size, text): each feature's JSON and the bytes of those before it in its area."""
    item = F.to_json(F.struct(F.col("feature_id").alias("id"), "kind", "tags", "geometry"))
    cls = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("feature_class"))
    stretch = F.floor(F.coalesce("feature_seq", F.lit(-1)) / STRETCH)
    rows = features.where(F.col("feature_class").isin(*CLASSES)).select("area_id", cls.alias("cls"), stretch.alias("stretch"), "feature_seq", item.alias("text"))
    rows = rows.withColumn("size", F.octet_length("text") + 1)
    key = ["area_id", "cls", "stretch"]
    up_to = Window.partitionBy("area_id").orderBy("cls", "stretch").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*key).agg(F.sum("size").alias("of_stretch"))
    starts = sums.withColumn("start", F.sum("of_stretch").over(up_to) - F.col("of_stretch")).drop("of_stretch")
    inside = Window.partitionBy(*key).orderBy("feature_seq", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("ends", F.sum("size").over(inside))
    return summed.join(starts, key).select("area_id", "cls", (F.col("start") + F.col("ends") - F.col("size")).alias("at"), "size", "text")


def document_chunks(features: DataFrame, areas: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(area_id, chunk, document): an area's document in numbered pieces, each a JSON object of its own.

    A piece has the arrays ``buildings``, ``roads`` and ``openLand`` with some
    features, in order; the pieces' arrays one after the other are those of
    ``osm.area_document``. Piece 0 has ``bbox`` and ``counts`` too and is there
    for areas without features as well. Features stay whole: a piece is no
    longer than ``chunk_bytes``, unless a single feature takes more than half
    of it; then numbers may have gaps.

    Bytes are added up over stretches of sequence numbers and then inside
    each, so no area is one group or one row. Features of other classes and of
    areas not given go nowhere; features without a sequence number come first;
    an area's repeated rows are one document, with the box that is greatest.
    """
    room = max((chunk_bytes - 1024) // 2, 1)
    placed = _placed(features)
    pieces = placed.groupBy("area_id", F.floor(F.col("at") / room).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "cls", "text"))).alias("items"))
    counts = placed.groupBy("area_id").agg(*[F.count_if(F.col("cls") == i).alias(n) for i, n in enumerate(CLASSES.values(), 1)])
    boxes = areas.where("area_id is not null").groupBy("area_id").agg(F.max(F.struct("north", "south", "east", "west")).alias("bbox"))
    numbers = F.struct(*[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in CLASSES.values()])
    heads = boxes.join(counts, "area_id", "left").select("area_id", F.lit(0).cast("bigint").alias("chunk"), F.to_json(F.struct("bbox", numbers.alias("counts"))).alias("head"))
    first = heads.join(pieces.where("chunk = 0"), ["area_id", "chunk"], "left").select("area_id", "chunk", "head", "items")
    later = pieces.where("chunk > 0").join(boxes, "area_id", "left_semi").select("area_id", "chunk", F.lit(None).cast("string").alias("head"), "items")

    def listed(number: int) -> Column:
        return F.concat_ws(",", F.transform(F.filter("items", lambda r: r["cls"] == number), lambda r: r["text"]))

    opening = F.when(F.col("head").isNull(), "{").otherwise(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(",")))
    arrays = [part for i, n in enumerate(CLASSES.values(), 1) for part in (F.lit(f'{"," if i > 1 else ""}"{n}":['), listed(i), F.lit("]"))]
    return first.unionByName(later).select("area_id", "chunk", F.concat(opening, *arrays, F.lit("}")).alias("document"))


def chunk_features(chunks: DataFrame) -> DataFrame:
    """Rows of features from pieces, read one by one: area_id, chunk, feature_seq inside the piece, feature_class, feature_id, kind, tags, geometry.

    (chunk, feature_seq) is the order of a class in its area. A piece that is
    null or no JSON object gives no rows.
    """
    read = chunks.select("area_id", "chunk", F.from_json("document", PIECE).alias("d"))

    def of_class(name: str, array: str) -> Column:
        row = lambda f, i: F.struct(i.alias("feature_seq"), F.lit(name).alias("feature_class"), f.alias("f"))
        return F.transform(F.coalesce(f"d.{array}", F.from_json(F.lit("[]"), ITEMS)), row)

    rows = read.select("area_id", "chunk", F.explode(F.concat(*[of_class(c, n) for c, n in CLASSES.items()])).alias("r"))
    return rows.select("area_id", "chunk", "r.feature_seq", "r.feature_class", F.col("r.f.id").alias("feature_id"), "r.f.kind", "r.f.tags", "r.f.geometry")
