"""Small helpers that the corpus operators have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, shared_dir, written

__all__ = ["NULL_ID", "PACKED", "by_part", "freeze", "fresh_path", "pack", "packed_batch", "part_count", "shared_dir", "text_tag", "text_total", "thaw", "unpack", "unpack_all", "written"]

#: A null identifier sorts before every other one.
NULL_ID = -(1 << 63)


def text_total(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, by which partitions are sized."""
    n, total = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(n), int(total)


def part_count(total_bytes: int, part_bytes: int, least: int = 4) -> int:
    return max(least, -(-total_bytes // part_bytes))


def text_tag(column: str = "text") -> Column:
    """Tells rows with one identifier but different texts apart."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, column after column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(payload: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def unpack_all(payloads, *types: str) -> list[np.ndarray]:
    got = [unpack(p, *types) for p in payloads]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in enumerate(types)]


def freeze(*columns: np.ndarray) -> bytes:
    """Arrays of any lengths, one after the other, compressed."""
    raw = [np.ascontiguousarray(c).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(c) for c in columns], "<u8").tobytes() + b"".join(raw))


def thaw(payload: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    lengths = np.frombuffer(raw, "<u8", len(types)).tolist()
    out, at = [], 8 * len(types)
    for t, n in zip(types, lengths):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, payload) for every part that occurs, rows in their order."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
    columns = [c[order] for c in columns]
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(part[lo]), pack(*[c[lo:hi] for c in columns])


PACKED = "part int, kind int, payload binary"


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["part", "kind", "payload"])
