"""Exact top-k inner products with vector-approximation files.

Vectors are kept in blocks. A block's approximation file holds one byte per
component: the number of the cell that the component lies in. From a query and
the cells follow a lower and an upper bound of every inner product; exact
vectors are read in the order of their bounds, and only until the k-th result
is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

_CELLS = 256
#: Queries bounded at once.
_TILE = 256


class ApproximationFile:
    """A block of integer vectors: cells in memory, exact rows read on demand."""

    def __init__(self, exact: np.ndarray):
        self.exact = exact
        self.rows_read = 0
        low, high = exact.min(axis=0), exact.max(axis=0)
        self.width = (high - low) // _CELLS + 1  # integers in a cell
        self.low = low
        self.cells = ((exact - low) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle of the bounds of each (query, row), and how far the truth may be off, per query."""
        half = (self.width - 1) / 2.0
        middle = self.cells * self.width + self.low + half
        # One unit beyond the cells covers rounding of sums far below 2**53.
        return queries.astype(np.float64) @ middle.T, np.abs(queries).astype(np.float64) @ half + 1.0

    def read(self, rows: np.ndarray) -> np.ndarray:
        self.rows_read += len(rows)
        return self.exact[rows]


def _block_top(file: ApproximationFile, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(query index, row, score) of each query's k best rows of a block, ties to smaller ids."""
    out = []
    for t in range(0, len(queries), _TILE):
        q = queries[t : t + _TILE]
        middle, off = file.bounds(q)
        middle[query_ids[t : t + _TILE, None] == ids[None, :]] = -np.inf
        n = middle.shape[1]
        floor = np.partition(middle, n - k, axis=1)[:, n - k] - off if n > k else np.full(len(q), -np.inf)
        for i in range(len(q)):
            # No row below the k-th best lower bound can be among the k best.
            near = np.flatnonzero((middle[i] + off[i] >= floor[i]) & np.isfinite(middle[i]))
            near = near[np.argsort(-middle[i, near], kind="stable")]
            best_rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            at, step = 0, 2 * k
            while at < len(near):
                if len(best) >= k and middle[i, near[at]] + off[i] < best[k - 1]:
                    break  # the k-th result is certain
                rows = near[at : at + step]
                score = file.read(rows) @ q[i]
                best_rows, best = np.r_[best_rows, rows], np.r_[best, score]
                order = np.lexsort((ids[best_rows], -best))[:k]
                best_rows, best = best_rows[order], best[order]
                at += step
            out.append((np.full(len(best), t + i), best_rows, best))
    return [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3)]


#: Integers that a double holds exactly; scores and bounds stay below.
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(id, dims, vector as array of longs) with floor(factor * x); unusable vectors are left out.

    By Cauchy and Schwarz no inner product passes the largest squared length;
    a vector whose squared length is no exact double is an error.
    """
    v = F.col("v")
    good = F.col("id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(good)
    scaled = lambda x: F.lit(float(factor)) * x.cast("double")
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(scaled(x)) + 1) * (F.abs(scaled(x)) + 1))
    wide = F.raise_error(F.concat(F.lit("components too large for exact scores in vector "), F.col("id").cast("string")))
    fits = F.when(squared < _EXACT, F.transform("v", lambda x: F.floor(scaled(x)).cast("long"))).otherwise(wide.cast("array<long>"))
    return plain.select("id", F.size("v").alias("dims"), fits.alias("vector"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, factor: int = 64, block_rows: int = 4096, query_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query.

    Components become floor(factor * x) and scores are their integer inner
    products; components so large that these may pass 2**53 are an error. Queries are the rows whose id is
    divisible by ``every``; candidates are all rows with another id. Ties go to
    the smaller id. All candidates come out where there are fewer than ``k``.

    Rows with a null id, a null vector, or a null or non-finite component take
    no part; vectors of different length are never compared. A repeated row
    counts once. An empty table gives an empty result.

    Candidates lie in blocks of about ``block_rows`` and queries in blocks of
    about ``query_rows``; each pair of blocks is one group, so a task holds one
    of each. A block's k best go on, never all pairs.
    """
    rows = shared.written(integer_vectors(vectors, id_col, vector_col, factor).distinct(), "vectors")
    n = rows.count()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n // (every * query_rows)))
    count = blocks * query_blocks
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    candidates = rows.select(F.lit(False).alias("asks"), own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "id", "dims", "vector")
    asking = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    queries = asking.select(F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("id", "vector"), F.lit(query_blocks)).cast("int").alias("q"), "id", "dims", "vector")
    cells = candidates.unionByName(queries).withColumn("cell", F.col("b") * query_blocks + F.col("q"))

    def run(batches):
        asks, ids, dims, raw = [], [], [], []
        for batch in batches:
            asks.append(batch.column("asks").to_numpy(zero_copy_only=False))
            ids.append(batch.column("id").to_numpy())
            dims.append(batch.column("dims").to_numpy())
            v = batch.column("vector")
            flat, edge = v.flatten().to_numpy(), np.append(0, np.cumsum(batch.column("dims").to_numpy()))
            raw += [flat[i:j].astype("<i8").tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
        if not ids:
            return
        asks, ids, dims = np.concatenate(asks), np.concatenate(ids), np.concatenate(dims)
        for d in np.unique(dims).tolist():
            c, q = np.flatnonzero((dims == d) & ~asks), np.flatnonzero((dims == d) & asks)
            if not len(c) or not len(q):
                continue
            matrix = lambda k: np.frombuffer(b"".join(raw[i] for i in k), "<i8").reshape(len(k), d)
            asked = matrix(q)
            who, row, score = _block_top(ApproximationFile(matrix(c)), ids[c], asked, ids[q], k)
            tag = [raw[i] for i in q[who]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][who]), pa.array(tag, pa.binary()), pa.array(ids[c][row]), pa.array(score)], names=["query_id", "query", "vec_id", "score"])

    found = cells.repartitionById(count, F.col("cell")).mapInArrow(run, "query_id long, query binary, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("query", F.xxhash64("query")).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
