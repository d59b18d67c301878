import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from laneweave.llm import packing
from laneweave.llm.packing import pack_documents
from laneweave.llm.sstable import Reader, crc32_of_ids, lookup, read_tokens, write_tokens

SCHEMA = "doc_id long, text string, ids string, start int"


def rows():
    out = [(i * 7 % 97 - 20, ("Some words, that vary %d. " % i) * (i % 40), "x", 1) for i in range(97)]
    return out + [(500, "long text " * 9000, "", 1), (501, None, None, None), (502, "", "", 0), (None, "no id", "", 0), (None, None, "", 0), out[5], out[5], (out[5][0], "other", "", 0)]


def ids_of(tokenizer, text):
    t = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_round_trip(spark):
    name = "byte_bpe_50k.json"
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    manifest = write_tokens(df, public_tokenizers.path(name), shard_bytes=20_000)
    assert manifest.count() > 3
    got = [(r.doc_id, r.start, r.n_tokens, r.c) for r in read_tokens(manifest).withColumn("c", crc32_of_ids()).collect()]
    want, at = [], 0
    for d, t in sorted(((d, t) for d, t, *_ in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(name, t)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(d,) for d in (data[5][0], 500, 501, 12345, -20, None)], "doc_id long")
    found = sorted((r.doc_id, len(r.ids) // 4) for r in lookup(manifest, asked).collect())
    assert found == sorted((d, n) for d, _, n, _ in want if d in (data[5][0], 500, 501, -20))
    path = manifest.orderBy("shard").collect()[-1].path
    shard = Reader(path)
    assert shard.get(10**12) == [] and shard.blocks_read == 0  # the filter answers
    shard.get(500)
    assert shard.blocks_read <= 2


@pytest.mark.parametrize("fan_in", [64, 2])
def test_packing_is_whole_and_gapless(spark, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    name, length = "word_bpe_49k.json", 256
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = pack_documents(df, public_tokenizers.path(name), length=length, windows=3).collect()
    sequences, pieces = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length > 0 and crc(ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, ids.tolist()))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length and at & (at - 1) == 0
    assert sum(sum(n for _, n in s) < length for s in sequences.values()) <= 8
    unique = {d: t for d, t, *_ in data if d is not None and sum(x[0] == d for x in data) == 1}
    for d, t in unique.items():
        whole, at = [], 0
        for start, n, total, ids in sorted(pieces[d]):
            assert start == at
            at += n
            whole += ids
        assert whole == ids_of(name, t) and at == total
    assert sum(r.length for r in got) == sum(len(ids_of(name, t)) for _, t, *_ in data)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    manifest = write_tokens(df, public_tokenizers.path("byte_bpe_50k.json"))
    assert read_tokens(manifest).count() == 0
    assert lookup(manifest, spark.createDataFrame([(1,)], "doc_id long")).count() == 0
