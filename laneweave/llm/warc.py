"""Dictionary-compressed WARC archives.

An archive starts with a skippable frame that holds a Zstandard dictionary
built from the archive's own records; every record follows as a frame of its
own, compressed with that dictionary, so a reader can start at any record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import slices
from .files import create, open_file

#: Skippable frame that marks a dictionary.
_MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one archive, which a task holds while it builds the dictionary.
ARCHIVE_BYTES = 16 << 20
_DICTIONARY_BYTES = 64 << 10

MANIFEST = "path string, n_records long"


def _record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    # Control characters would end a header line.
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {refers_to}"] if is_revisit else []),
        "Content-Type: text/html; charset=utf-8",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {0 if is_revisit else len(payload)}",
    ]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + (b"" if is_revisit else payload) + b"\r\n\r\n"


def dictionary_of(records: list[bytes], size: int = _DICTIONARY_BYTES) -> bytes:
    """A dictionary from all records of an archive; empty where they are too few to build one."""
    pieces = [r[i : i + 4096] for r in records for i in range(0, len(r), 4096)]
    size = min(size, sum(map(len, pieces)) // 8)
    if size < 1024 or len(pieces) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, pieces, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # records too much alike, or too short
        return b""


def write_archive(stream, records: list[bytes]) -> None:
    raw = dictionary_of(records)
    stream.write(struct.pack("<II", _MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
    for r in records:
        stream.write(packer.compress(r))
    stream.close()


def read_records(stream):
    """Every record of an archive, one after the other."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _MAGIC:
        raise ValueError("no dictionary frame")
    raw = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = b""
    while True:
        frame, out = unpacker.decompressobj(), []
        while not frame.eof:
            chunk = left or stream.read(64 << 10)
            left = b""
            if not chunk:
                if out:
                    raise ValueError("archive ends within a record")
                return
            out.append(frame.decompress(chunk))
        left = frame.unused_data
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return fields, rest[:n]


def with_record_type(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """``pages`` with digest, n_bytes and refers_to (null for a response).

    Of rows with equal payloads of ``least_bytes`` or more, that with the
    largest identifier is the response and the others refer to it. Payloads
    are told apart by SHA-1 and length.
    """
    body = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    marked = pages.withColumns({"digest": F.sha1(body), "n_bytes": F.octet_length(body).cast("long")})
    # Short payloads match nothing and stay out of the join. The other side is written, so that a payload of very many
    # pages has only exchanges under the join and can be split.
    copies = (
        marked.where(F.col("n_bytes") >= least_bytes)
        .groupBy("digest", "n_bytes")
        .agg(F.max(F.col(f"`{id_col}`")).alias("latest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and latest is not null")
        .select("digest", "n_bytes", "latest")
    )
    copies = shared.written(copies, "copies")
    joined = marked.where(F.col("n_bytes") >= least_bytes).join(copies, ["digest", "n_bytes"], "left")
    referring = joined.withColumn("refers_to", F.when(~F.col(f"`{id_col}`").eqNullSafe(F.col("latest")), F.col("latest"))).drop("latest")
    alone = marked.where(F.col("n_bytes") < least_bytes)
    return referring.unionByName(alone.withColumn("refers_to", F.lit(None).cast(referring.schema["refers_to"].dataType)))


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page; returns the manifest of archives (path, n_records).

    The payload is the page in UTF-8. A revisit record keeps its digest and
    length and the page it refers to, but no payload. Null payloads are empty;
    null and odd URLs are written without, or percent-encoded. Repeated rows
    are written one for one (of those with the largest identifier, each is a
    response). Every record has an identifier of its own; that of the page is a
    field. An empty table gives no archive. A task holds ``archive_bytes``
    of payload, or one longer page. Only archives in the manifest count: a lost
    attempt's files are not in it.
    """
    spark = pages.sparkSession
    folder = folder or shared.fresh_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    plain = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{payload_col}`").alias("body"))
    typed = with_record_type(plain, "page", "body").select("page", "url", "digest", "refers_to", F.coalesce("body", F.lit("")).alias("body"))

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size = [], 0

        def close():
            path, stream = create(folder, f"{part:06d}.warc.zst")
            write_archive(stream, held)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)]})

        for batch in slices(batches, "body"):
            for page, url, digest, refers_to, body in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(_record(page, url, body.encode("utf-8"), digest, refers_to, refers_to is not None, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return shared.written(typed.mapInArrow(run, MANIFEST), "warc-manifest")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _page_of(value: str | None) -> int | None:
    return None if value is None else int(value)


def read_warc(manifest: DataFrame) -> DataFrame:
    """Every record of the archives; payload is null for revisits.

    Digest and length of a stored payload are computed anew and must agree
    with the record's own.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with open_file(path) as stream:
                    for record in read_records(stream):
                        fields, payload = parse(record)
                        kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n):
                            raise ValueError(f"payload differs from its digest in {path}")
                        refers_to = _page_of(fields.get("X-Refers-To-Page"))
                        rows.append((_page_of(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), kind, refers_to, digest, n, payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return manifest.repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(run, RECORDS)
