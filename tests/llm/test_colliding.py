"""Two words of 1,024 letters whose sums of powers modulo 2^64 agree for every base."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from laneweave.llm.arrays import BYTE_CODES, prefix_sums, run_hash, text_bytes, word_hashes
from laneweave.llm.contamination import find_contamination, hit_words
from laneweave.llm.minhash import near_set_groups
from laneweave.llm.packing import pack_documents
from laneweave.llm.simhash import drop_near_duplicates
from laneweave.llm.sstable import read_tokens, write_tokens
from laneweave.llm.substring import remove_repeated_passages
from laneweave.llm.suffix import remove_repeated_bytes

V = "".join("ab"[i.bit_count() & 1] for i in range(1024))
W = V.translate(str.maketrans("ab", "ba"))


def test_the_words_collide_as_sums_of_powers_and_not_as_words():
    data, at = text_bytes(pa.array([V, W]))
    sums = run_hash(prefix_sums(BYTE_CODES[data]), at[:-1], np.diff(at))
    own = word_hashes(data, at[:-1], at[1:])
    assert sums[0] == sums[1] and own[0] != own[1]


def test_words_of_all_lengths_have_hashes_of_their_bytes_alone():
    words = ["x" * n for n in range(1, 600)] + ["x" * n + "y" for n in range(600)] + ["é" * n for n in range(1, 300)]
    data, at = text_bytes(pa.array(words))
    h = word_hashes(data, at[:-1], at[1:])
    assert len(np.unique(h)) == len(set(words))
    back, to = text_bytes(pa.array(words[::-1]))
    assert (word_hashes(back, to[:-1], to[1:])[::-1] == h).all()


def test_token_ids(spark):
    df = spark.createDataFrame([(1, f"x {W} {V}")], "doc_id long, text string")
    for name, got in (("byte_bpe_50k.json", lambda p: np.frombuffer(bytes(read_tokens(write_tokens(df, p)).first()["ids"]), "<u4").tolist()), ("word_bpe_49k.json", lambda p: [i for r in sorted(pack_documents(df, p).collect(), key=lambda r: r.start) for i in np.frombuffer(bytes(r.ids), "<u2").tolist()])):
        path = public_tokenizers.path(name)
        assert list(got(path)) == Tokenizer.from_file(path).encode(f"x {W} {V}", add_special_tokens=False).ids + [2]


def test_contamination(spark):
    nine = " ".join(f"n{i}" for i in range(9))
    docs = spark.createDataFrame([(1, f"{nine} {V}"), (2, f"{nine} {W}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{nine} {W}")], "item_id long, text string")
    assert {r.doc_id: r.n for r in find_contamination(docs, items).withColumn("n", hit_words()).collect()} == {1: 0, 2: 10}


def test_substrings(spark):
    r = np.random.default_rng(3)
    words = [f"u{i}" for i in r.integers(0, 10**9, 29)]
    text = lambda x: " ".join([*words[:15], x, *words[15:]])
    rows = [(1, text("plain")), (2, text(V)), (3, text(W)), (4, text(V)), (5, text(W))]
    got = {x.doc_id: x.n_removed for x in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 30, 5: 30}
    rows = [(1, V), (2, W), (3, W), (4, V)]
    plain = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    first = {}
    for d, t in rows:
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], d)
    want = {}
    for d, t in rows:
        gone = {i for s in range(len(t) - 49) if first[t[s : s + 50]] < d for i in range(s, s + 50)}
        want[d] = len(gone)
    assert {x.doc_id: x.n_removed for x in plain.collect()} == want


def test_near_copies(spark):
    df = spark.createDataFrame([(1, V), (2, W), (3, W)], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == [1, 2]
    assert {r.doc_id: r.component_id for r in near_set_groups(df).collect()} == {1: 1, 2: 2, 3: 2}
