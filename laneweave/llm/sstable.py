"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers. Layout:

- data blocks: entries in key order, each ``shared, unshared, size`` as
  variable-length integers, the rest of the key after the prefix it shares
  with the key before it, and the ids; a block is compressed as a whole;
- index: last key, offset and length of every block;
- Bloom filter over the identifiers;
- footer: places of the parts, numbers of documents and ids, bytes of an id.

A lookup asks the filter, finds the block by binary search in the index and
reads that block alone.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .arrays import U64, slices, xxhash64_long
from .files import create, open_file
from .tokens import encoder

_FOOTER = struct.Struct("<QQQQQQB7s")
_MAGIC = b"lwsst01"
_BLOOM_BITS, _BLOOM_PROBES = 10, 7


def _key(doc_id: int | None, nth: int) -> bytes:
    """Keys sort as identifiers do, null first; ``nth`` counts rows of one identifier."""
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + (1 << 63) if doc_id is not None else 0, nth)


def _id_of(key: bytes) -> int | None:
    known, value, _ = struct.unpack(">BQI", key)
    return value - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = xxhash64_long(ids)
    step = (h >> U64(33)) | U64(1)
    return (h[:, None] + step[:, None] * np.arange(_BLOOM_PROBES, dtype=U64)[None, :]) % U64(bits)


class Writer:
    """Writes one shard from entries in key order."""

    def __init__(self, stream, id_bytes: int, block_bytes: int = 1 << 18):
        self.stream, self.id_bytes, self.block_bytes = stream, id_bytes, block_bytes
        self.block, self.last, self.at = [], b"", 0
        self.held = 0
        self.index: list[bytes] = []
        self.ids: list[int] = []
        self.n_docs = self.n_ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, nth: int, value: bytes) -> None:
        key = _key(doc_id, nth)
        same = 0
        if self.block:
            while same < len(key) and key[same] == self.last[same]:
                same += 1
        self.block.append(_varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value)
        self.last = key
        self.held += len(value) + 16
        self.n_docs += 1
        self.n_ids += len(value) // self.id_bytes
        if doc_id is not None and nth == 0:
            self.ids.append(doc_id)
        if self.held >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = self.pack.compress(b"".join(self.block))
            self.stream.write(raw)
            self.index.append(self.last + struct.pack("<QQ", self.at, len(raw)))
            self.at += len(raw)
            self.block, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.ids) * _BLOOM_BITS)
        table = np.zeros(bits, bool)
        if self.ids:
            table[_bloom_places(np.array(self.ids, np.int64), bits).ravel().astype(np.int64)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(table).tobytes()
        self.stream.write(index + bloom + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_ids, self.id_bytes, _MAGIC))
        self.stream.close()


class Reader:
    """Reads one shard: all entries in order, or those of one identifier."""

    def __init__(self, path: str):
        self.file = open_file(path)
        size = self.file.size()
        index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, self.id_bytes, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"not a token shard: {path}")
        raw = self._read(index_at, index_len)
        self.keys = [raw[i : i + 13] for i in range(0, len(raw), 29)]
        self.places = [struct.unpack("<QQ", raw[i + 13 : i + 29]) for i in range(0, len(raw), 29)]
        self.bloom_at, self.bloom_len, self.bloom = bloom_at, bloom_len, None
        self.blocks_read = 0

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: int):
        self.blocks_read += 1
        raw = zstandard.ZstdDecompressor().decompress(self._read(*self.places[block]))
        at, key = 0, b""
        while at < len(raw):
            same, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:same] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def __iter__(self):
        for b in range(len(self.keys)):
            for key, value in self._entries(b):
                yield _id_of(key), value

    def may_hold(self, doc_id: int) -> bool:
        if self.bloom is None:
            raw = self._read(self.bloom_at, self.bloom_len)
            self.bits = struct.unpack("<Q", raw[:8])[0]
            self.bloom = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8))
        return bool(self.bloom[_bloom_places(np.array([doc_id], np.int64), self.bits).ravel().astype(np.int64)].all())

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every row with this identifier."""
        if not self.may_hold(doc_id):
            return []
        out = []
        low, high = _key(doc_id, 0), _key(doc_id, 0xFFFFFFFF)
        for b in range(bisect_left(self.keys, low), len(self.keys)):
            for key, value in self._entries(b):
                if key > high:
                    return out
                if key >= low:
                    out.append(np.frombuffer(value, f"<u{self.id_bytes}"))
        return out


MANIFEST = "shard int, path string, first_id long, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = 24 << 20, folder: str | None = None) -> DataFrame:
    """Encode whole texts and write shards; returns the manifest, one row a shard.

    Documents are dealt out by ranges of identifiers, so that shards follow
    each other in ascending order; ``end_id`` ends every document. Null and
    empty texts are the end id alone. A null identifier sorts first; rows with
    one identifier stand side by side, ordered by text. An empty table gives
    an empty manifest. Only files that the manifest names count: what a lost
    attempt leaves behind is not in it.
    """
    spark = docs.sparkSession
    _, total = shared.text_total(docs, text_col)
    folder = folder or shared.fresh_path(spark, "tokens")
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ranged = inner.repartitionByRange(shared.part_count(total, shard_bytes), "id").sortWithinPartitions("id", "text")

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.type).tobytes()
        writer = None
        before: list = []
        for batch in slices(batches, "text"):
            if writer is None:
                part = TaskContext.get().partitionId()
                path, stream = create(folder, f"{part:08d}.tokens")
                writer, first, nth = Writer(stream, enc.type.itemsize), batch.column("id")[0].as_py(), 0
            ids, at = enc.encode(batch.column("text"))
            raw, at = ids.tobytes(), at * enc.type.itemsize
            for i, doc in enumerate(batch.column("id").to_pylist()):
                nth = nth + 1 if before == [doc] else 0
                before = [doc]
                writer.add(doc, nth, raw[at[i] : at[i + 1]] + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [path], "first_id": pa.array([first], pa.int64()), "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    return shared.written(ranged.mapInArrow(run, MANIFEST), "manifest")


def _per_shard(manifest: DataFrame) -> tuple[DataFrame, int]:
    shards = manifest.count()
    placed = manifest.withColumn("nth", (F.row_number().over(W.orderBy("shard")) - 1).cast("int"))
    return placed, max(1, shards)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the shards.

    ``start`` is the number of ids before the document in the whole order;
    ``ids`` are little-endian unsigned 32-bit integers.
    """
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed, shards = _per_shard(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = Reader(path)
                rows, held = [], 0
                for doc, value in shard:
                    ids = np.frombuffer(value, f"<u{shard.id_bytes}")
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += 4 * len(ids)
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return placed.select("nth", "path", "base").repartitionById(shards, F.col("nth")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows) -> pa.RecordBatch:
    doc, start, n, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted identifiers, reading only blocks that may hold them.

    Identifiers go to the shard of their range; those not there give no row,
    null ones neither.
    """
    shards = [(r.first_id, r.path) for r in manifest.orderBy("shard").collect()]  # one row a shard
    firsts = [-(1 << 63) if f is None else f for f, _ in shards]
    ids = wanted.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id is not null").distinct()

    def route(batches):
        for batch in batches:
            want = batch.column("id").to_numpy()
            to = np.searchsorted(firsts, want, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(to, 0).astype(np.int32)), batch.column("id")], names=["nth", "id"])

    def run(batches):
        for batch in batches:
            nth, want = batch.column("nth").to_numpy(), batch.column("id").to_pylist()
            for s in np.unique(nth).tolist():
                shard = Reader(shards[s][1])
                rows = [(w, v.astype("<u4").tobytes()) for w, n in zip(want, nth) if n == s for v in shard.get(w)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "ids"])

    if not shards:
        return ids.selectExpr("id as doc_id", "cast(null as binary) as ids").limit(0)
    return ids.mapInArrow(route, "nth int, id long").repartitionById(len(shards), F.col("nth")).mapInArrow(run, "doc_id long, ids binary")


def crc32_of_ids(column: str = "ids"):
    """CRC-32 of the ids' bytes, unsigned."""
    return F.crc32(F.col(column))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
