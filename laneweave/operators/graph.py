"""The street graph of many areas at once.

Two notions of an edge are kept: ``segments`` has every way's pieces, parallels
included, and ``edges`` one row for each unordered pair of nodes, whose
attributes are those merged last.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.geo import haversine_m, map_midpoint, node_key
from ..sources.scratch import written
from .proximity import SIDEWALK_M, within_distance
from .validate import implies_sidewalk, is_routable, is_sidewalk_path, keep_segments


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    segments: DataFrame


def explode_segments(roads: DataFrame, geometry: str = "geometry") -> DataFrame:
    """A row for each pair of consecutive points: a, b and segment_index; the other columns stay."""
    g = F.col(geometry)
    pairs = F.transform(F.sequence(F.lit(0), F.size(g) - 2), lambda i: F.struct(F.get(g, i).alias("a"), F.get(g, i + 1).alias("b")))
    rest = [c for c in roads.columns if c != geometry]
    return roads.where(F.size(g) >= 2).select(*rest, F.posexplode(pairs).alias("segment_index", "__s")).select(*rest, "segment_index", "__s.a", "__s.b")


def road_segments(features: DataFrame) -> DataFrame:
    """Segments of the routable roads that are long enough, with keys, length and the tag's sidewalk flag."""
    roads = features.where((F.col("feature_class") == "road") & is_routable(F.col("kind"), F.col("geometry")))
    kept = roads.select("project_id", "feature_id", "feature_seq", "kind", implies_sidewalk(F.col("kind"), F.col("tags")).alias("has_sidewalk"), "geometry")
    cut = explode_segments(kept).withColumns({"length_m": haversine_m(F.col("a"), F.col("b")), "a_key": node_key(F.col("a")), "b_key": node_key(F.col("b"))})
    return keep_segments(cut)


def with_drawn_sidewalks(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments whose middle is near a drawn sidewalk get the flag too."""
    drawn = explode_segments(edits.where(is_sidewalk_path(F.col("type"), F.col("path"))).select("project_id", F.col("path").alias("geometry")))
    middles = segments.where("not has_sidewalk").select("project_id", "feature_id", "feature_seq", "segment_index", map_midpoint(F.col("a"), F.col("b")).alias("p"))
    key = ["project_id", "feature_id", "feature_seq", "segment_index"]
    near = within_distance(middles, drawn, SIDEWALK_M).select(*key).distinct().withColumn("__near", F.lit(True))
    return segments.join(near, key, "left").withColumn("has_sidewalk", F.col("has_sidewalk") | F.coalesce("__near", F.lit(False))).drop("__near")


#: So many whole numbers of 64 and of 32 bits there are; null is one more, before them all.
_LONGS, _INTS = Decimal(2**64), Decimal(2**32)


def _packed(seq: Column, index: Column, end: int) -> Column:
    """(seq, index, end) as one decimal of the same order, nulls first: unlike a struct, an aggregate updates it in place."""
    place = lambda c, n: F.coalesce(c.cast("decimal(20,0)") + F.lit(n / 2 + 1), F.lit(Decimal(0)))
    return ((place(seq, _LONGS) * F.lit(_INTS + 1) + place(index, _INTS)) * F.lit(Decimal(2)) + F.lit(Decimal(end))).cast("decimal(38,0)")


def _unpacked(key: Column, seq: DataType, index: DataType) -> Column:
    """struct(feature_seq, segment_index, end) of what was packed."""
    over = lambda c, n: ((c - c % F.lit(n)) / F.lit(n)).cast("decimal(38,0)")
    value = lambda c, n, t: F.when(c > 0, (c - F.lit(n / 2 + 1)).cast(t))
    row = over(key, Decimal(2))
    first, second = value(over(row, _INTS + 1), _LONGS, seq), value(row % F.lit(_INTS + 1), _INTS, index)
    return F.struct(first.alias("feature_seq"), second.alias("segment_index"), (key % F.lit(Decimal(2))).cast("int").alias("end"))


def graph_nodes(segments: DataFrame) -> DataFrame:
    """(project_id, node, point, node_seq): both ends of all segments; the point merged last stands for the node.

    Segments are read once, and all that is kept of a node is of fixed size, so
    that ends are merged by hashing before the shuffle and never sorted:
    feature_seq and segment_index are whole numbers. An end that is null has
    the point of two nulls.
    """
    end = lambda key, p, n: F.struct(F.col(key).alias("node"), F.col(p).alias("point"), _packed(F.col("feature_seq"), F.col("segment_index"), n).alias("at"))
    ends = segments.select("project_id", F.explode(F.array(end("a_key", "a", 0), end("b_key", "b", 1))).alias("__e")).select("project_id", "__e.*")
    names = segments.schema["a"].dataType.names
    merged = ends.groupBy("project_id", "node").agg(*[F.max_by(f"point.{c}", "at").alias(f"__{c}") for c in names], F.min("at").alias("at"))
    seq = _unpacked(F.col("at"), segments.schema["feature_seq"].dataType, segments.schema["segment_index"].dataType)
    return merged.select("project_id", "node", F.struct(*[F.col(f"__{c}").alias(c) for c in names]).alias("point"), seq.alias("node_seq"))


def graph_edges(segments: DataFrame) -> DataFrame:
    """One edge for each unordered pair of nodes, with the attributes of the last segment."""
    attrs = F.struct("feature_id", "segment_index", "kind", "length_m", "has_sidewalk")
    low, high = F.least("a_key", "b_key"), F.greatest("a_key", "b_key")
    merged = segments.groupBy("project_id", low.alias("u"), high.alias("v")).agg(F.max_by(attrs, F.struct("feature_seq", "segment_index")).alias("last"))
    return merged.select("project_id", "u", "v", "last.*")


def adjacency(edges: DataFrame) -> DataFrame:
    one = edges.select("project_id", F.col("u").alias("node"), F.col("v").alias("neighbour"), "length_m")
    return one.unionByName(edges.select("project_id", F.col("v").alias("node"), F.col("u").alias("neighbour"), "length_m"))


def node_degrees(segments: DataFrame) -> DataFrame:
    """Number of distinct neighbours of each node."""
    one = segments.select("project_id", F.col("a_key").alias("node"), F.col("b_key").alias("other"))
    both = one.unionByName(segments.select("project_id", F.col("b_key").alias("node"), F.col("a_key").alias("other")))
    return both.distinct().groupBy("project_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def dead_end_nodes(degrees: DataFrame) -> DataFrame:
    return degrees.where("degree <= 1")


def dead_end_segments(segments: DataFrame, dead_ends: DataFrame) -> DataFrame:
    """Segments with a dead end at either end; parallels stay."""
    ends = dead_ends.select("project_id", F.col("node").alias("__node"), F.lit(True).alias("__dead"))
    a = ends.withColumnsRenamed({"__node": "a_key", "__dead": "__dead_a"})
    b = ends.withColumnsRenamed({"__node": "b_key", "__dead": "__dead_b"})
    joined = segments.join(a, ["project_id", "a_key"], "left").join(b, ["project_id", "b_key"], "left")
    return joined.where("__dead_a or __dead_b").select(*segments.columns)


def sidewalk_coverage(segments: DataFrame) -> DataFrame:
    n, s = F.count(F.lit(1)), F.count_if(F.col("has_sidewalk"))
    return segments.groupBy("project_id").agg(n.alias("segments"), s.alias("with_sidewalk"), F.sum("length_m").alias("total_length_m")).withColumn(
        "score", F.when(F.col("segments") > 0, F.round(F.col("with_sidewalk") / F.col("segments") * 100)).otherwise(0.0).cast("int")
    )


def build_graph(features: DataFrame, edits: DataFrame | None = None) -> Graph:
    """Nodes, edges and segments of every project's roads; only drawn sidewalks change it, and only the flag."""
    segments = road_segments(features)
    if edits is not None:
        segments = with_drawn_sidewalks(segments, edits)
    return Graph(graph_nodes(segments), graph_edges(segments), segments)


def network_report(features: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Per project: nodes, edges, dead ends, segments, dead-end segments, sidewalk coverage and length.

    Segments are written once, as three branches read them. Degrees are counted
    once and give nodes, edges (half of the degrees' sum) and dead ends.
    """
    segments = road_segments(features)
    if edits is not None:
        segments = with_drawn_sidewalks(segments, edits)
    segments = written(segments, "segments")
    degrees = node_degrees(segments)
    shape = degrees.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.count_if(F.col("degree") <= 1).alias("dead_ends")
    )
    dead = dead_end_segments(segments, dead_end_nodes(degrees)).groupBy("project_id").agg(F.count(F.lit(1)).alias("dead_end_segments"))
    report = sidewalk_coverage(segments).join(shape, "project_id").join(dead, "project_id", "left")
    return report.withColumn("dead_end_segments", F.coalesce("dead_end_segments", F.lit(0).cast("bigint")))
