import random

import numpy as np
import pyarrow as pa

from laneweave.llm import language
from laneweave.llm.language import _features, fit, held_out, keep_identified, predict


def test_every_label_is_learned(spark, monkeypatch):
    """More labels than were learned before, and a sample that is spread over all of them."""
    monkeypatch.setattr(language, "FIT_ALL", 120 * 8)
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for c in range(120):
        words = ["".join(r.choice(letters) for _ in range(5)) for _ in range(12)]
        rows += [(100 * c + i, " ".join(r.choice(words) for _ in range(40)), f"x{c:03}") for i in range(20)]
    rows += [(20_000 + i, "the same text", "x000") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = fit(docs)
    assert len(model.languages) == 120
    got = predict(docs.where(held_out()).where("doc_id < 20000"), model).collect()
    assert {x.lang for x in got} == {f"x{c:03}" for c in range(120)}
    assert sum(x.lang == x.lang_pred for x in got) > 0.9 * len(got)


def test_the_machines_reject_what_no_family_takes(spark):
    """Fitted on some hundred documents of each label. Clean documents stay; texts in a script that no label has go; columns named as the prediction stay as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", "'mine' as lang_pred", "-1D as score")
    odd = [(10**6, "这是一个没有人学过的语言的文本" * 20, None), (10**6 + 1, "言葉は誰も学んでいない言語で書かれている" * 10, None), (10**6 + 5, "слово", None), (10**6 + 2, None, None), (10**6 + 3, "", None), (10**6 + 4, "12 + 34", None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string").selectExpr("*", "'mine' as lang_pred", "-1D as score")
    kept = keep_identified(docs.unionByName(odd))
    assert kept.columns == docs.columns
    rows = kept.collect()
    # What is too short to tell stays.
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {10**6 + 5}
    assert {(r.lang_pred, r.score) for r in rows} == {("mine", -1.0)}


def test_without_a_label_every_text_with_a_letter_stays(spark):
    rows = [(1, "some words", None), (2, "12", None), (3, None, None), (4, "слово", None), (4, "слово", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in keep_identified(docs).collect()) == [1, 4, 4]
    assert keep_identified(docs.limit(0)).count() == 0


def test_clean_documents_stay_at_every_size(spark):
    for size in ("sf0.001", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text", "lang")
        gone = docs.join(keep_identified(docs), "doc_id", "left_anti").collect()
        assert not [r.doc_id for r in gone if any(c.isalpha() for c in r.text or "")]


def test_families_and_votes_as_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    rows = predict(docs.select("doc_id", "text"), model).where("lang_pred <> 'und'").limit(150).collect()
    squash = lambda m: 1 / (1 + np.exp(-max(-30.0, min(30.0, 4 * float(m)))))
    for r in rows:
        x = np.append(_features(pa.array([r.text]))[0], np.float32(1))
        margins = [float(x @ w) for w in model.family_machines]
        family = model.families[margins.index(max(margins))]
        inside = model.inside[family]
        votes, belief = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0)
        for a, b, w in model.pairs[family]:
            p = squash(x @ w)
            votes[a if p >= 0.5 else b] += 1
            belief[a] += p
            belief[b] += 1 - p
        best = max(inside, key=lambda c: (votes[c], belief[c], -inside.index(c)))
        score = squash(max(margins)) * (belief[best] / (len(inside) - 1) if len(inside) > 1 else 1)
        assert r.lang_pred == best and abs(r.score - score) < 1e-4, r.doc_id
