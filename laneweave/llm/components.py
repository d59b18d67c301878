"""Connected components of an edge table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star round over edges a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written, so that the join below has nothing but exchanges under it and a node of very many edges can be split.
    least = shared.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest in reach.

    ``edges`` has two columns of longs, in any direction, repeats allowed. Each
    round's edges are written to the shared folder. Rounds grow with the
    logarithm of the longest chain; ``rounds`` only guards against a defect.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    now = shared.written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = shared.written(_star(_star(now, True), False), "edges")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
