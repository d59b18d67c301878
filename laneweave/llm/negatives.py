"""Hard-negative mining by a secondary sort.

Scores of an anchor's pairs travel as packed keys (anchor, descending score,
id): one binary column whose byte order is the order in which they are wanted.
Keys are dealt out by anchor and sorted within partitions; one pass over a
partition then reads each anchor's rows from its best score down. A positive
opens a window below its score, a negative is emitted for every open window
that its score lies in, and a window closes when it has enough. Nothing of an
anchor is held but its open windows.

Only pairs that can matter are packed: anchors stream past chunks of the other
rows, first for each chunk's best positives, then, with the windows known, for
each chunk's best negatives of every window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import give_back

_EXACT, _EXACT_SINGLE = float(1 << 53), float(1 << 24)
#: Anchors scored at once against a chunk.
_TILE = 64
#: Fields of a packed key, big-endian, so that bytes sort as numbers; of equal scores positives come first, as they open windows.
_KEY = np.dtype([("anchor", ">u8"), ("tag", ">u8"), ("below", ">u8"), ("negative", ">u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def labelled_vectors(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, factor: int) -> DataFrame:
    """(id, label, dims, vector) with floor(factor * x) as doubles; rows that cannot take part are left out.

    A vector whose scaled squared length is no exact double is an error: no
    inner product passes the largest of them.
    """
    v = F.col("v")
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("v")).where(good)
    scaled = lambda x: F.lit(float(factor)) * x.cast("double")
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(scaled(x)) + 1) * (F.abs(scaled(x)) + 1))
    wide = F.raise_error(F.concat(F.lit("components too large for exact scores in vector "), F.col("id").cast("string")))
    fits = F.when(squared < _EXACT, F.transform("v", lambda x: F.floor(scaled(x)).cast("double"))).otherwise(wide.cast("array<double>"))
    return plain.select("id", "label", F.size("v").alias("dims"), fits.alias("vector"))


def packed(anchor: np.ndarray, tag: np.ndarray, score: np.ndarray, ids: np.ndarray, negative) -> pa.Array:
    """Keys whose bytes sort by anchor, descending score, positives before negatives, and id."""
    out = np.empty(len(anchor), _KEY)
    up = lambda x: x.astype(np.int64).view(np.uint64) ^ _SIGN
    out["anchor"], out["tag"], out["below"], out["id"], out["negative"] = up(anchor), up(tag), ~up(score), up(ids), negative
    return pa.Array.from_buffers(pa.binary(_KEY.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, ...]:
    fixed = column.cast(pa.binary(_KEY.itemsize))
    raw = np.frombuffer(fixed.buffers()[1], _KEY, len(fixed), fixed.offset * _KEY.itemsize) if len(fixed) else np.zeros(0, _KEY)
    back = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return back(raw["anchor"]), back(raw["tag"]), back(~raw["below"].astype(np.uint64)), back(raw["id"]), raw["negative"].astype(bool)


class _Chunk:
    """Rows that anchors are scored against, of one length, by ascending id."""

    def __init__(self, ids, labels, matrix):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.matrix = ids[order], labels[order], matrix[order]
        self.reach = float((matrix * matrix).sum(axis=1).max())
        self.of_label = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels).tolist()}
        self._single = None

    def scores(self, asked: np.ndarray, rows=None) -> np.ndarray:
        """Exact inner products; single precision where every partial sum fits."""
        own = self.matrix if rows is None else self.matrix[rows]
        if max(self.reach, float((asked * asked).sum(axis=1).max())) < _EXACT_SINGLE:
            if self._single is None:
                self._single = self.matrix.astype(np.float32)
            own = self._single if rows is None else self._single[rows]
            return asked.astype(np.float32) @ own.T
        return asked @ own.T


def _positives(chunk: _Chunk, anchor, label, asked, k: int):
    """(anchor row, chunk row, score) of each anchor's k best of its own label; ties to the smaller id."""
    out = []
    for x in np.unique(label).tolist():
        rows = chunk.of_label.get(x)
        if rows is None:
            continue
        who = np.flatnonzero(label == x)
        for i in range(0, len(who), _TILE):
            w = who[i : i + _TILE]
            s = chunk.scores(asked[w], rows).astype(np.float64)
            s[chunk.ids[rows][None, :] == anchor[w][:, None]] = -np.inf
            for _ in range(min(k, len(rows))):
                best = s.argmax(axis=1)  # the first of equals has the smallest id
                score = s[np.arange(len(w)), best]
                some = np.isfinite(score)
                out.append((w[some], rows[best[some]], score[some].astype(np.int64)))
                s[np.arange(len(w)), best] = -np.inf
    return [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3)]


def _negatives(chunk: _Chunk, anchor, label, asked, windows: list, k: int, low: tuple[int, int], high: tuple[int, int]):
    """(anchor row, chunk row, score) of the k best of other labels in each of an anchor's windows."""
    out = []
    for i in range(0, len(anchor), _TILE):
        part = windows[i : i + _TILE]
        floor = np.array([min((w for w in p if w >= 0), default=-1) for p in part])
        least = np.where(floor < 0, np.inf, -(-floor * low[0] // low[1]))
        s = chunk.scores(asked[i : i + _TILE])
        near = (s >= least[:, None]) & (chunk.labels[None, :] != label[i : i + _TILE, None]) & (chunk.ids[None, :] != anchor[i : i + _TILE, None])
        who, row = np.nonzero(near)
        score = s[who, row].astype(np.int64)
        order = np.lexsort((-score, who))  # stable: ids ascend within a score
        who, row, score = who[order], row[order], score[order]
        edge = np.searchsorted(who, np.arange(len(part) + 1))
        take = np.zeros(len(who), bool)
        for a, p in enumerate(part):
            own = score[edge[a] : edge[a + 1]]
            for w in {w for w in p if w >= 0}:
                first = np.searchsorted(-own, -(high[0] * w // high[1]))
                last = np.searchsorted(-own, (-w * low[0]) // low[1], "right")
                take[edge[a] + first : edge[a] + min(last, first + k)] = True
        out.append((who[take] + i, row[take], score[take]))
    return [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3)]


def _meet(rows: DataFrame, anchors: DataFrame, chunk_rows: int, work, schema: str) -> DataFrame:
    """``work(chunk, batch of anchors)`` for every chunk of rows and all anchors.

    A task holds one chunk; anchors stream past it. There are as many tasks as
    chunks, however many anchors there are.
    """
    chunks = max(1, -(-rows.count() // chunk_rows))
    none = F.lit(None).cast(anchors.schema["windows"].dataType)
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("tag"), "label", "dims", "vector", none.alias("windows"))
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(True).alias("asks"), "id", "tag", "label", "dims", "vector", "windows")

    def run(batches):
        held: dict[int, list] = {}
        ready: dict[int, _Chunk] = {}
        for batch in batches:  # the chunk's rows come first
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                for side in (False, True):
                    at = np.flatnonzero((dims == d) & (asks == side))
                    if not len(at):
                        continue
                    part = batch.take(pa.array(at))
                    matrix = part.column("vector").flatten().to_numpy().reshape(len(at), d)
                    ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                    if not side:
                        held.setdefault(d, []).append((ids, labels, matrix))
                        continue
                    if d not in ready and d in held:
                        ready[d] = _Chunk(*[np.concatenate(c) for c in zip(*held.pop(d))])
                    if d in ready:
                        tag = part.column("tag").to_numpy()
                        windows = part.column("windows").to_pylist()
                        yield from work(ready[d], ids, tag, labels, matrix, windows)
        give_back()

    both = own.unionByName(asking).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("asks")
    return both.drop("chunk").mapInArrow(run, schema)


def sorted_keys(keys: DataFrame, parts: int) -> DataFrame:
    """The secondary sort: all keys of an anchor in one partition, in byte order."""
    return keys.repartition(parts, F.substring("key", 1, 16)).sortWithinPartitions("key")


def _first_positives(keys: DataFrame, k: int) -> DataFrame:
    """(id, tag, windows): the first k scores of each anchor, from sorted keys."""

    def run(batches):
        last, held = None, []
        for batch in batches:
            anchor, tag, score, _, _ = unpacked(batch.column("key"))
            done = []
            for a, t, s in zip(anchor.tolist(), tag.tolist(), score.tolist()):
                if (a, t) != last:
                    if held:
                        done.append((*last, held))
                    last, held = (a, t), []
                if len(held) < k:
                    held.append(s)
            yield _window_batch(done)
        if held:
            yield _window_batch([(*last, held)])

    return keys.mapInArrow(run, "id long, tag long, windows array<long>")


def _window_batch(rows) -> pa.RecordBatch:
    ids, tags, windows = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(windows, pa.list_(pa.int64()))], names=["id", "tag", "windows"])


def _emitted(keys: DataFrame, positives: int, negatives: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """One pass over sorted keys: positives open windows, negatives are emitted for those they lie in."""

    def run(batches):
        last, opened, windows = None, 0, []
        for batch in batches:
            out = []
            for a, t, s, i, negative in zip(*(c.tolist() for c in unpacked(batch.column("key")))):
                if (a, t) != last:
                    last, opened, windows = (a, t), 0, []
                if not negative:
                    if opened < positives:
                        opened += 1
                        windows.append([i, s, 0])
                    continue
                still = []
                for w in windows:
                    if s * high[1] > w[1] * high[0]:
                        still.append(w)  # not far enough below the positive yet
                    elif s * low[1] >= w[1] * low[0]:
                        w[2] += 1
                        out.append((a, w[0], w[2], i, w[1], s))
                        if w[2] < negatives:
                            still.append(w)
                windows = still
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return keys.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), factor: int = 256, chunk_rows: int = 16_384, key_rows: int = 500_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives for each anchor and positive.

    Anchors are the rows whose id is divisible by ``every``. Components become
    floor(factor * x) and scores are integer inner products; higher scores come
    first, ties by the smaller id. An anchor's positives are its first
    ``positives`` other rows of the same label; for each of them the first
    ``negatives`` rows of another label come out whose score is from ``low`` to
    ``high`` (fractions) of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part; vectors of different lengths never meet. A repeated row counts
    once; of rows that share an identifier and differ, each is a row of its own
    that never meets the others. Components so large that scores may pass 2^53
    are an error. An empty table gives an empty result.

    A task holds a chunk of about ``chunk_rows`` rows, past which all anchors
    stream, or reads sorted keys; there are as many tasks as chunks.
    """
    rows = shared.written(labelled_vectors(vectors, id_col, label_col, vector_col, factor).distinct(), "vectors")
    # Rows of one identifier are told apart by their content.
    anchors = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).withColumn("tag", F.xxhash64("label", "vector")).withColumn("windows", F.lit(None).cast("array<long>"))

    def best(chunk, ids, tag, label, matrix, _):
        who, row, score = _positives(chunk, ids, label, matrix, positives)
        yield pa.RecordBatch.from_arrays([packed(ids[who], tag[who], score, chunk.ids[row], 0)], names=["key"])

    def hard(chunk, ids, tag, label, matrix, windows):
        who, row, score = _negatives(chunk, ids, label, matrix, windows, negatives, low, high)
        yield pa.RecordBatch.from_arrays([packed(ids[who], tag[who], score, chunk.ids[row], 1)], names=["key"])

    found = shared.written(_meet(rows, anchors, chunk_rows, best, "key binary"), "positive-keys")
    parts = shared.part_count(found.count(), key_rows, 1)
    windows = _first_positives(sorted_keys(found, parts), positives)
    opened = anchors.drop("windows").join(windows, ["id", "tag"])
    opened = shared.written(opened.select("id", "tag", "label", "dims", "vector", "windows"), "opened")
    more = _meet(rows, opened, chunk_rows, hard, "key binary")
    keys = shared.written(found.unionByName(more), "keys")
    return _emitted(sorted_keys(keys, shared.part_count(keys.count(), key_rows, 1)), positives, negatives, low, high)
