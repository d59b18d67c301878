"""Points and the candidates that may be nearest to them, by blocks of cells.

A point lies in one block of ``WIDE`` by ``WIDE`` cells; a candidate goes to
every block from which it may be within the cutoff. Blocks with many points or
candidates are dealt out in pieces, every piece of the one with every piece of
the other. Within a piece the points are halved again and again: candidates
that are farther from the middle of a part than its nearest candidate and its
width can be nearest to none of its points, and go. So a point is compared
with the few that are left for its part, however many lie in its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import written

#: A piece has so many times ``POINTS`` points and ``CANDIDATES`` candidates at most, about; how often points are halved at most.
CROWD, DEEPEST = 4096, 32
POINTS, CANDIDATES = 16, 64
#: Cells along a block's side; pairs compared at once.
WIDE, AT_ONCE = 8, 1 << 18

BLOCK = ["project_id", "level", "__row", "__col"]
PIECE = [*BLOCK, "__points", "__slice"]
ENDS = ["__ax", "__ay", "__bx", "__by"]


def line_cells(ax: Column, ay: Column, bx: Column, by: Column, size: Column, within: Column | None = None, across: Column | None = None) -> Column:
    """Cells that a line passes, row by row, so that a long slanting one does not fill its box.

    With ``within``, a cell ``across`` times as wide, those inside it only.
    """
    xa, ya, xb, yb = ax / size, ay / size, bx / size, by / size

    def run(low: Column, high: Column, side: str) -> Column:
        low, high = F.floor(low), F.floor(high)
        if within is None:
            return F.sequence(low, high)
        start = (within[side] * across).cast("bigint")
        low, high = F.greatest(low, start), F.least(high, start + across.cast("bigint") - 1)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))

    def row(r: Column) -> Column:
        # The part of the line within the row and a little beyond.
        at = lambda y: F.when(ya == yb, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - ya) / (yb - ya))))
        x = lambda t: xa + t * (xb - xa)
        one, other = x(at(r - 0.001)), F.when(ya == yb, xb).otherwise(x(at(r + 1.001)))
        return F.transform(run(F.least(one, other) - 0.001, F.greatest(one, other) + 0.001, "x"), lambda c: F.struct(r.alias("y"), c.alias("x")))

    return F.flatten(F.transform(run(F.least(ya, yb), F.greatest(ya, yb), "y"), row))


def _block(cell: Column) -> Column:
    return F.floor(cell / WIDE)


def _blocks_beside(size: Column) -> Column:
    """Blocks of the cells that a candidate passes and of those beside them."""

    def around(c: Column) -> Column:
        at = lambda dy, dx: F.struct(_block(c["y"] + dy).alias("row"), _block(c["x"] + dx).alias("col"))
        return F.array(*[at(dy, dx) for dy in (-1, 1) for dx in (-1, 1)])

    return F.array_distinct(F.flatten(F.transform(line_cells(*[F.col(c) for c in ENDS], size), around)))


def _distances(x, y, ends) -> np.ndarray:
    """Distances of points (a column) from segments (a row)."""
    ax, ay, dx, dy = ends
    square = dx * dx + dy * dy
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(square == 0, 1.0, square), 0.0, 1.0)
    return np.hypot(x - ax - t * dx, y - ay - t * dy)


def may_be_nearest(x, y, reach, ax, ay, bx, by) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of points and of segments, pair by pair: all that are nearest within reach, but for rounding.

    Segments that are as near as the nearest but for what rounding may take are
    kept, so that whoever computes distances anew decides between them.
    """
    ends = np.stack([ax, ay, bx - ax, by - ay])
    slack = 4096 * np.finfo(float).eps * max(np.abs(v).max(initial=1.0) for v in (x, y, ax, ay, bx, by))
    parts = [(np.arange(len(x)), np.arange(len(ax)), 0)]
    while parts:
        i, j, depth = parts.pop()
        if len(i) > 8 and len(i) * len(j) > 4096 and depth < DEEPEST:
            x0, x1, y0, y1 = x[i].min(), x[i].max(), y[i].min(), y[i].max()
            half = np.hypot(x1 - x0, y1 - y0) / 2
            away = _distances((x0 + x1) / 2, (y0 + y1) / 2, ends[:, j])
            j = j[away <= min(away.min() + 2 * half, reach[i].max() + half) + slack]
            if not len(j):
                continue
            if half > 0:
                order = np.argpartition(x[i] if x1 - x0 >= y1 - y0 else y[i], len(i) // 2)
                parts += [(i[order[: len(i) // 2]], j, depth + 1), (i[order[len(i) // 2 :]], j, depth + 1)]
                continue
        step = max(1, AT_ONCE // len(j))
        for k in range(0, len(i), step):
            some = i[k : k + step]
            away = _distances(x[some, None], y[some, None], ends[:, j])
            one, other = np.nonzero(away <= np.minimum(away.min(axis=1) + slack, reach[some] * (1 + 1e-6) + slack)[:, None])
            yield some[one], j[other]


def _pairs(columns: list[str], values: list[str]):
    def of_piece(asks: pa.Table, held: pa.Table) -> pa.Table:
        number = lambda t, c: t[c].to_numpy()
        found = []
        if len(asks) and len(held):
            found = list(may_be_nearest(number(asks, "__wx"), number(asks, "__wy"), number(asks, "__reach"), *[number(held, c) for c in ENDS]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.array([], dtype=np.int64) for k in (0, 1))
        taken = [asks[c].take(i) for c in columns] + [held[c].take(j) for c in values]
        return pa.table(taken, names=[*columns, *values])

    return of_piece


def meet(asks: DataFrame, held: DataFrame, px: float, order: list[str]) -> DataFrame:
    """``asks`` with each of the candidates of its project that may be nearest to it.

    ``asks`` has distinct rows of project_id and a place in world pixels (__wx,
    __wy), its level and how far it looks (__reach), no farther than a cell of
    its level is wide; ``held`` candidates with their ends (``ENDS``) in world
    pixels, of which the first by ``order`` stands for all with equal ends.
    No pair repeats.
    """
    size = F.lit(px) / F.pow(F.lit(2.0), F.col("level"))
    rest = [c for c in held.columns if c not in ["project_id", *ENDS]]
    sound = [F.col(c).between(-1e300, 1e300) for c in ENDS]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    one = held.where(sound[0] & sound[1] & sound[2] & sound[3]).groupBy("project_id", *ENDS).agg(first).select("project_id", *ENDS, "__first.*")
    one = written(one, "candidates")
    placed = written(asks.withColumns({"__row": _block(F.floor(F.col("__wy") / size)), "__col": _block(F.floor(F.col("__wx") / size))}), "points")
    levels = placed.select("project_id", F.col("level").alias("level")).distinct()
    # Dealt out anew: a project with few bytes of candidates would have all its blocks made by one task.
    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    beside = one.join(levels, "project_id").repartition(parts, "level", *ENDS).withColumn("__block", F.explode(_blocks_beside(size)))
    beside = beside.select("project_id", "level", F.col("__block.row").alias("__row"), F.col("__block.col").alias("__col"), *ENDS, *rest)
    # Pieces that hold about as many rows each; a block without one or the other has none.
    pieces = lambda df, most, name: df.groupBy(*BLOCK).agg(F.ceil(F.count("*") / F.lit(CROWD * most)).alias(name))
    sizes = written(pieces(placed, POINTS, "__of_points").join(pieces(beside, CANDIDATES, "__of_slices"), BLOCK), "pieces")
    # The piece of one's own, and all of the other side.
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = placed.join(sizes, BLOCK).withColumn("__points", own("__of_points", "__wx", "__wy", "__reach")).withColumn("__slice", every("__of_slices")).drop("__of_points", "__of_slices")
    right = beside.join(sizes, BLOCK).withColumn("__slice", own("__of_slices", *ENDS)).withColumn("__points", every("__of_points")).drop("__of_points", "__of_slices")
    columns, values = asks.columns, [*ENDS, *rest]
    schema = StructType([placed.schema[c] for c in columns] + [right.schema[c] for c in values])
    return left.groupBy(*PIECE).cogroup(right.groupBy(*PIECE)).applyInArrow(_pairs(columns, values), schema)
