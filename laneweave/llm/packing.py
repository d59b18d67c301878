"""Bounded-space online packing of documents into fixed-length sequences.

Every partition keeps a fixed number of open windows. A document's ids beyond
whole windows go best-fit: into the open window that they fill most. When none
fits, the fullest is topped up with the head of the piece and emitted, and the
rest goes on. What is open at the end of a partition is merged with that of
other partitions, level by level, until one task's worth is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import slices
from .sstable import crc32
from .tokens import encoder

PIECES = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, open boolean, part int, ids_crc32 long, ids binary"
#: Partitions, and later groups, whose leftovers one task merges.
FAN_IN = 64


class _Rows:
    """Pieces of emitted sequences, as columns."""

    def __init__(self, part: int, first_sequence: int, kind):
        self.part, self.next, self.kind = part, first_sequence, kind
        self.rows: list[tuple] = []
        self.held = 0

    def emit(self, pieces, is_open: bool = False) -> None:
        """pieces: (id, start, doc_tokens, ids) in their order in the sequence."""
        offset = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), total, self.next, offset, is_open, self.part, crc32(ids), np.ascontiguousarray(ids, self.kind).tobytes()))
            offset += len(ids)
            self.held += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = list(zip(*self.rows)) if self.rows else [()] * len(names)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


class _OpenWindows:
    """A fixed number of windows that still take pieces."""

    def __init__(self, length: int, windows: int, out: _Rows):
        self.length, self.windows, self.out = length, windows, out
        self.held: list[list] = []
        self.free: list[int] = []

    def _put(self, w: int, piece) -> None:
        self.held[w].append(piece)
        self.free[w] -= len(piece[3])
        if not self.free[w]:
            self.out.emit(self.held.pop(w))
            self.free.pop(w)

    def add(self, piece) -> None:
        doc, start, total, ids = piece
        while len(ids) >= self.length:  # whole windows stand alone
            self.out.emit([(doc, start, total, ids[: self.length])])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            n = len(ids)
            fits = [(f, w) for w, f in enumerate(self.free) if f >= n]
            if fits:
                self._put(min(fits)[1], (doc, start, total, ids))
                return
            if len(self.held) < self.windows:
                self.held.append([])
                self.free.append(self.length)
                self._put(len(self.held) - 1, (doc, start, total, ids))
                return
            f, w = min((f, w) for w, f in enumerate(self.free))
            self._put(w, (doc, start, total, ids[:f]))
            start, ids = start + f, ids[f:]


def _merge(pieces, length: int, out: _Rows, last: bool) -> None:
    """Leftover pieces one after the other; the tail stays open, or ends in powers of two."""
    window, free = [], length
    for doc, start, total, ids in pieces:
        while len(ids):
            n = min(free, len(ids))
            window.append((doc, start, total, ids[:n]))
            start, ids, free = start + n, ids[n:], free - n
            if not free:
                out.emit(window)
                window, free = [], length
    if not window:
        return
    if not last:
        out.emit(window, is_open=True)
        return
    left = length - free
    for bit in reversed(range(left.bit_length())):
        room = left & (1 << bit)
        if room:
            short = []
            while room:
                doc, start, total, ids = window.pop(0)
                n = min(room, len(ids))
                short.append((doc, start, total, ids[:n]))
                room -= n
                if n < len(ids):
                    window.insert(0, (doc, start + n, total, ids[n:]))
            out.emit(short)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, windows: int = 16, end_id: int = 2) -> DataFrame:
    """Pieces of sequences of at most ``length`` ids, each id in exactly one piece.

    Columns: the identifier (named as ``id_col``), start (ids of the document
    before the piece), length, ids_crc32, doc_tokens (with the end id),
    sequence_id, offset (gapless from 0 within a sequence) and ids (binary,
    little-endian unsigned integers of 2 bytes, or 4 where the vocabulary needs
    them). All sequences are full but the last few, whose lengths are powers of
    two, so there is no padding.

    Null and empty texts are the end id alone. Repeated rows and rows with
    null identifiers are packed one for one. An empty table gives no pieces.
    A partition holds ``windows`` windows in memory, whatever its size.
    """

    def pack(batches):
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        out = _Rows(part, part << 33, enc.type)
        open_windows = _OpenWindows(length, windows, out)
        end = np.array([end_id], enc.type)
        for batch in slices(batches, "text"):
            ids, at = enc.encode(batch.column("text"))
            for i, doc in enumerate(batch.column("id").to_pylist()):
                own = np.concatenate([ids[at[i] : at[i + 1]], end])
                open_windows.add((doc, 0, len(own), own))
                if out.held > 1 << 20:
                    yield out.batch()
        for pieces in open_windows.held:
            out.emit(pieces, is_open=True)
        yield out.batch()

    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    packed = shared.written(inner.mapInArrow(pack, PIECES), "packed")
    done = packed.where("not open")
    left, level = packed.where("open"), 0
    groups = (packed.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level += 1
        groups = -(-groups // FAN_IN)
        last = groups == 1

        def merge(batches, level=level, last=last):
            kind = encoder(tokenizer).type
            out, rows = None, []
            for batch in batches:
                if out is None and batch.num_rows:
                    group = batch.column("part")[0].as_py()
                    out = _Rows(group, (1 << 62) + (level << 56) + (group << 24), kind)
                columns = [batch.column(c).to_pylist() for c in ("id", "start", "doc_tokens", "ids")]
                rows += [(d, s, t, np.frombuffer(i, kind)) for d, s, t, i in zip(*columns)]
            if out is not None:
                _merge(rows, length, out, last)
                yield out.batch()

        grouped = left.withColumn("part", (F.col("part") / FAN_IN).cast("int")).repartitionById(groups, F.col("part")).sortWithinPartitions("sequence_id", "offset")
        merged = shared.written(grouped.mapInArrow(merge, PIECES), "merged")
        done = done.unionByName(merged.where("not open"))
        if last:
            return done.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
        left = merged.where("open")
