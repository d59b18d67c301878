"""Sizes of street graphs kept up to date by what changes, without a full report of every project.

A store has, per batch of changes, the differences in how many segments each
edge has (``edges``), in each node's degree (``degrees``) and in each
project's size (``sizes``), in folders by batch and by a hash of the project.
A batch reads, of the earlier ones, the folders that its projects hash to and
joins them by edge and by node, so other folders are not opened and a large
project is as many tasks as it has keys. Folders of a batch are overwritten
when it is run again, and it reads only those before it: a batch that was
lost half-way or is repeated leaves the same store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .graph import road_segments

BUCKETS = 256

_NODE = "struct<lat_e6:bigint,lng_e6:bigint>"
_KEYS = {"edges": ["project_id", "u", "v"], "degrees": ["project_id", "node"], "sizes": ["project_id"]}
_SUMS = {"edges": ["n"], "degrees": ["degree"], "sizes": ["nodes", "edges", "dead_ends"]}
_SCHEMAS = {
    "edges": f"project_id bigint, u {_NODE}, v {_NODE}, n bigint",
    "degrees": f"project_id bigint, node {_NODE}, degree bigint",
    "sizes": "project_id bigint, nodes bigint, edges bigint, dead_ends bigint",
}


def create(spark: SparkSession, root: str) -> None:
    """An empty store. Batches are numbered from 0."""
    for name, schema in _SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}/batch=-1/bucket=-1")


def _bucket() -> Column:
    return F.pmod(F.hash("project_id"), F.lit(BUCKETS)).alias("bucket")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name] + ", batch bigint, bucket int").parquet(f"{root}/{name}")


def _append(df: DataFrame, root: str, name: str, batch: int) -> DataFrame:
    """Write a batch's differences, and read them back."""
    path = f"{root}/{name}/batch={batch}"
    spark = df.sparkSession
    spark.createDataFrame([], _SCHEMAS[name]).write.mode("overwrite").parquet(f"{path}/bucket=-1")
    df.select("*", _bucket()).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
    return spark.read.schema(_SCHEMAS[name] + ", bucket int").parquet(path).drop("bucket")


def _edge_differences(changes: DataFrame) -> DataFrame:
    parts = []
    for action, n in (("add", 1), ("remove", -1)):
        cut = road_segments(changes.where(F.col("action") == action))
        parts.append(cut.select("project_id", F.least("a_key", "b_key").cast(_NODE).alias("u"), F.greatest("a_key", "b_key").cast(_NODE).alias("v"), F.lit(n).cast("bigint").alias("n")))
    return parts[0].unionByName(parts[1]).groupBy(*_KEYS["edges"]).agg(F.sum("n").alias("n")).where("n <> 0")


def _with_before(delta: DataFrame, earlier: DataFrame, name: str) -> DataFrame:
    """Differences with what their keys had before, as ``before``."""
    (value,) = _SUMS[name]
    both = delta.select(*_KEYS[name], F.col(value).alias("d"), F.lit(0).cast("bigint").alias("b")).unionByName(
        earlier.select(*_KEYS[name], F.lit(None).cast("bigint").alias("d"), F.col(value).alias("b"))
    )
    summed = both.groupBy(*_KEYS[name]).agg(F.sum("d").alias(value), F.sum("b").alias("before"))
    return summed.where(F.col(value).isNotNull())


def apply_changes(changes: DataFrame, root: str, batch: int) -> DataFrame:
    """Take a batch of added and removed roads into the store; sizes of the projects it names.

    ``changes`` has the columns of features, ``project_id`` and ``action``,
    ``add`` or ``remove``; a road that changes is removed as it was and added
    as it is. Other actions, classes and kinds without routes change nothing.
    Repeated rows count as often as they stand there; what is removed without
    having been added counts against a later addition. Batches come in order;
    one that is repeated must have the same changes.

    Returns project_id, nodes_before, edges_before, nodes, edges, dead_ends
    and ``affected``: whether nodes or edges are another number than before,
    so that its routes are out of date. Projects of the batch that end up as
    they were are rows too, with false; a null project is none.
    """
    spark = changes.sparkSession
    named = changes.where("project_id is not null")
    d_edges = _append(_edge_differences(named), root, "edges", batch)
    projects = named.select(F.col("project_id").cast("bigint")).distinct()
    buckets = [r.bucket for r in projects.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
    earlier = lambda name: _read(spark, root, name).where((F.col("batch") < batch) & F.col("bucket").isin(buckets))
    there = lambda c: (c > 0).cast("bigint")

    flips = _with_before(d_edges, earlier("edges"), "edges").select("project_id", "u", "v", (there(F.col("before") + F.col("n")) - there(F.col("before"))).alias("flip")).where("flip <> 0")
    ends = flips.select("project_id", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"), F.col("flip").alias("degree"))
    d_degrees = _append(ends.groupBy("project_id", "node").agg(F.sum("degree").alias("degree")).where("degree <> 0"), root, "degrees", batch)

    before, after = F.col("before"), F.col("before") + F.col("degree")
    dead = lambda c: (c == 1).cast("bigint")
    moved = _with_before(d_degrees, earlier("degrees"), "degrees").groupBy("project_id").agg(
        F.sum(there(after) - there(before)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.sum(dead(after) - dead(before)).alias("dead_ends")
    )
    d_sizes = _append(moved, root, "sizes", batch)

    sums = _SUMS["sizes"]
    old = earlier("sizes").join(projects, "project_id", "left_semi").groupBy("project_id").agg(*[F.sum(c).alias(f"{c}_before") for c in sums])
    joined = projects.join(old, "project_id", "left").join(d_sizes, "project_id", "left").fillna(0)
    sizes = joined.select("project_id", "nodes_before", "edges_before", *[(F.col(f"{c}_before") + F.col(c)).alias(c) for c in sums])
    return sizes.withColumn("affected", (F.col("nodes") != F.col("nodes_before")) | (F.col("edges") != F.col("edges_before")))


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """project_id, nodes, edges and dead_ends of all projects with a street, from the small ``sizes`` alone."""
    return _read(spark, root, "sizes").groupBy("project_id").agg(*[F.sum(c).alias(c) for c in _SUMS["sizes"]]).where("nodes > 0")


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """The same store with all batches so far as one, written beside it: many small batches make many folders."""
    create(spark, new_root)
    for name, values in _SUMS.items():
        summed = _read(spark, root, name).groupBy(*_KEYS[name]).agg(*[F.sum(c).alias(c) for c in values])
        kept = summed.where(" or ".join(f"{c} <> 0" for c in values))
        kept.select("*", _bucket()).write.mode("append").partitionBy("bucket").parquet(f"{new_root}/{name}/batch=-1")


def affected_stream(changes: DataFrame, root: str) -> DataStreamWriter:
    """Writer of a stream of changes: each micro-batch goes to the store, its rows of ``apply_changes`` to ``root/affected/batch=<number>``."""

    def take(batch: DataFrame, number: int) -> None:
        apply_changes(batch, root, number).write.mode("overwrite").parquet(f"{root}/affected/batch={number}")

    return changes.writeStream.foreachBatch(take)
