import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from laneweave.llm.shared import written

from .test_contamination import brute
from .test_repeats import brute_words


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], sf), name))
        assert kept[-1].columns == columns
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    # language: whatever has a letter stays
    assert set(rows[1]) == {i for i, r in rows[0].items() if any(c.isalpha() for c in r.text or "")}
    # near copies: exact ones are gone, the first of them stays
    first = {}
    for i in sorted(rows[1]):
        first.setdefault(tuple((rows[1][i].text or "").lower().split()), i)
    assert set(rows[2]) <= set(first.values()) and len(rows[2]) > 0.8 * len(first)
    assert len(first) < len(rows[1])
    # substrings: as brute force
    want = {i: (n, gone, text) for i, n, gone, text in brute_words([(i, r.text) for i, r in rows[2].items()], 20)}
    assert set(rows[3]) == {i for i, (n, gone, _) in want.items() if gone < n or not gone}
    for i, r in rows[3].items():
        assert r.text == (want[i][2] if want[i][1] else rows[2][i].text)
        assert r.n_chars == (len(r.text) if want[i][1] else rows[2][i].n_chars)
    # benchmark: as brute force
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in brute([(i, r.text) for i, r in rows[3].items()], items, 10) if n}
    assert hit and set(rows[4]) == set(rows[3]) - hit
    # packing: whole, gapless, full
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, r in rows[4].items():
        assert sum((ids for _, ids in sorted(pieces[i])), []) == t.encode(r.text, add_special_tokens=False).ids + [2]
    assert sum(sum(n for _, n in s) < 4096 for s in sequences.values()) <= 12
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0]) and corpus_pipeline.ORACLE_SQL is None
