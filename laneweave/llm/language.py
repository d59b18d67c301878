"""Language identification by hierarchical discrimination.

Texts become counts of hashed three-byte runs, in small letters, square-rooted
and normalised.
One linear support vector machine per language family (against the rest) picks
the family; within it, one machine per pair of languages votes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .arrays import lower_ascii, slices, text_bytes

DIMENSIONS = 1 << 12
#: Labelled documents per language that the machines are fitted on; a sample by hash.
FIT_PER_LANGUAGE = 500
#: Labelled documents of all languages together that they are fitted on at most, but one of each language at least.
FIT_ALL = 16_000
#: Share of held-out labelled texts below whose score keep_identified puts its threshold, the part of that score that it takes, and bytes from which a text is long enough to be told by it.
RARE, MARGIN, LONG_ENOUGH = 0.001, 0.5, 200

# Family of common ISO 639-1 codes. Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0], language)


def _folded(data: np.ndarray) -> np.ndarray:
    """Small letters for capitals of ASCII and Latin-1; a space for other ASCII characters."""
    data = lower_ascii(data)
    after = np.concatenate([np.zeros(1, bool), data[:-1] == 0xC3])
    data = data + ((after & (data >= 0x80) & (data <= 0x9E)).astype(np.uint8) << 5)
    return np.where((data < 0x80) & ((data < 97) | (data > 122)), np.uint8(32), data)


def _features(batch_column) -> np.ndarray:
    """A row of DIMENSIONS for each text."""
    data, offsets = text_bytes(batch_column)
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, DIMENSIONS), np.float32)
    b = _folded(data).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    row = np.repeat(np.arange(n), np.diff(offsets))[:-2]
    ok = row == np.repeat(np.arange(n), np.diff(offsets))[2:]  # within one text
    counts = np.bincount(row[ok] * DIMENSIONS + (h[ok] >> np.uint32(20)).astype(np.int64), minlength=n * DIMENSIONS)
    x = np.sqrt(counts.reshape(n, DIMENSIONS).astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _small(batches, rows: int = 500):
    for batch in slices(batches, "text"):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, penalty: float = 1e-4) -> np.ndarray:
    """Linear machine for y in -1, 1: averaged subgradient steps on the hinge loss, classes weighed alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    order = np.random.default_rng(0)
    w = np.zeros(x.shape[1] + 1, np.float32)
    mean, step = np.zeros_like(w), 0
    for r in range(rounds):
        for k in np.array_split(order.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            rate = 1.0 / (0.05 * (step + 20))
            some = np.hstack([x[k].astype(np.float32), np.ones((len(k), 1), np.float32)])
            near = y[k] * (some @ w) < 1
            w = (w * (1 - rate * penalty) + rate * ((y[k] * weight[k])[near] @ some[near]) / len(k)).astype(np.float32)
            if r >= rounds // 2:
                mean += w
    return mean / max(1, step - step // 2)


def _machines(spark: SparkSession, x: np.ndarray, languages: list[str], names: list[tuple[str, tuple[str, str] | None]]) -> list[np.ndarray]:
    """A machine for each name, a family against the rest or a pair of its languages, each fitted in a task."""
    if not names:
        return []
    codes, own = np.unique(languages, return_inverse=True)
    kin = np.array([family_of(c) for c in codes.tolist()], object)[own]
    held = spark.sparkContext.broadcast((x, codes[own], kin, names))

    def run(batches):
        x, own, kin, names = held.value
        for batch in batches:
            for i in batch.column("id").to_pylist():
                family, pair = names[i]
                if pair is None:
                    w = _fit(x, np.where(kin == family, 1.0, -1.0).astype(np.float32))
                else:
                    rows = np.flatnonzero((own == pair[0]) | (own == pair[1]))
                    w = _fit(x[rows], np.where(own[rows] == pair[0], 1.0, -1.0).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["id", "w"])

    rows = spark.range(0, len(names), 1, min(len(names), 1_000)).mapInArrow(run, "id long, w binary").collect()
    return [np.frombuffer(r.w, np.float32) for r in sorted(rows, key=lambda r: r.id)]


class Model:
    """Machines of families and of the pairs of languages within each."""

    def __init__(self, spark: SparkSession, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        self.inside: dict[str, list[str]] = {}
        for c in self.languages:
            self.inside.setdefault(family_of(c), []).append(c)
        self.families = sorted(self.inside)
        # With a single family there is nothing to separate.
        names = [(f, None) for f in self.families if len(self.families) > 1]
        pairs = [(f, pair) for f in self.families for pair in combinations(self.inside[f], 2)]
        machines = _machines(spark, x, languages, names + pairs)
        self.family_machines = np.stack(machines[: len(names)]) if names else None
        self.pairs: dict[str, list[tuple[str, str, np.ndarray]]] = {f: [] for f in self.families}
        for (f, (a, b)), w in zip(pairs, machines[len(names) :]):
            self.pairs[f].append((a, b, w))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        squash = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        if self.family_machines is None:
            family, score = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = x @ self.family_machines.T
            family = margins.argmax(axis=1)
            score = squash(margins[np.arange(len(x)), family])
        out = np.empty(len(x), object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            if not len(rows):
                continue
            inside = self.inside[f]
            votes = np.zeros((len(rows), len(inside)))
            belief = np.zeros_like(votes)
            for a, b, w in self.pairs[f]:
                p = squash(x[rows] @ w)
                ia, ib = inside.index(a), inside.index(b)
                votes[:, ia] += p >= 0.5
                votes[:, ib] += p < 0.5
                belief[:, ia] += p
                belief[:, ib] += 1 - p
            best = (votes + belief / (len(inside) + 1)).argmax(axis=1)
            out[rows] = np.array(inside, object)[best]
            if len(inside) > 1:
                score[rows] *= belief[np.arange(len(rows)), best] / (len(inside) - 1)
        return list(out), score


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that only measure: crc32 of the identifier as text, modulo 3, is 1. Null is not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_PER_LANGUAGE) -> Model | None:
    """Learn from labelled documents that are not held out.

    Every label is learned. ``per_language`` documents of each (fewer, but one
    at least, where there are so many languages that ``FIT_ALL`` would be
    passed) are taken by a hash of identifier and text, wherever they stand;
    their features, of bounded size, are all that comes to the driver, and
    machines are fitted in tasks. Null labels, texts and identifiers teach
    nothing. None if there is no label at all.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("id is not null and text is not null and lang is not null")
    known = known.where(~held_out("id")).select("text", "lang", F.xxhash64("id", "text").alias("hash"))
    counts = shared.written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low")), "languages")
    languages = counts.count()
    if not languages:
        return None
    per_language = max(1, min(per_language, FIT_ALL // languages))
    # By hash more than are wanted, so that there are enough, and of these the first; the smallest hash always counts.
    share = F.lit(2.0 * per_language + 50) / F.col("n")
    most = F.when(share < 0.99, (share * float(1 << 64) - float(1 << 63)).cast("long")).otherwise(F.lit((1 << 63) - 1))
    limits = counts.select("lang", F.greatest("low", most).alias("most"))
    picked = known.join(F.broadcast(limits), "lang").where(F.col("hash") <= F.col("most")).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    picked = picked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("hash"))).where(F.col("rank") <= per_language).select("text", "lang")

    def run(batches):
        for batch in _small(batches):
            x = _features(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = picked.mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.x))
    return Model(docs.sparkSession, np.stack([np.frombuffer(r.x, np.float16) for r in rows]), [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); columns of these names are replaced.

    ``und``, score 0, for a null text, one without a letter, and where nothing
    was learned. Only the text counts. Rows stay one for one; an empty table
    gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    inner = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest) if c != text_col], F.lit(0).alias("none")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def lettered(column) -> np.ndarray:
        data, offsets = text_bytes(column)
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(letter)])
        out = total[offsets[1:]] > total[offsets[:-1]]
        for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
            out[i] = any(c.isalpha() for c in column[i].as_py() or "")
        return out

    def run(batches):
        model = held.value
        for batch in _small(batches):
            has = lettered(batch.column("text"))
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None and has.any():
                got, sure = model.predict(_features(batch.column("text")))
                lang = [g if h else "und" for g, h in zip(got, has)]
                score = np.where(has, np.clip(sure, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "text", "lang_pred", "score"])

    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], "lang_pred", "score")


def least_score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """Score below which a long text is in none of the languages: half of what all but one in a thousand held-out labelled texts reach.

    Measured on all of them. 0 where there is none: then nothing is rejected by its score.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    known = known.where(held_out("id") & F.col("lang").isNotNull() & (F.octet_length("text") >= LONG_ENOUGH)).select("text")
    found = predict(known, model).where("lang_pred <> 'und'").agg(F.percentile_approx("score", RARE, 100_000)).first()[0]
    return MARGIN * (found or 0.0)


def keep_identified(docs: DataFrame, least: float | None = None, **columns) -> DataFrame:
    """Documents whose language is known, columns as they are.

    Null texts and texts without a letter go, and of texts of ``LONG_ENOUGH``
    bytes and more those that score below ``least`` (None: ``least_score``, as
    held-out labelled texts set it): no family takes them, or no language of
    the family. Shorter texts stay, as they cannot be told. Where no label can
    be learned from, the machines decide nothing and every text with a letter
    stays. Rows count one by one, repeated ones too; an empty table gives an
    empty result.
    """
    text_col = columns.get("text_col", "text")
    model = fit(docs, **columns)
    if model is None:
        return docs.where(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    if least is None:
        least = least_score(docs, model, **{k: v for k, v in columns.items() if k in ("id_col", "text_col", "lang_col")})
    # Columns of these names may be the documents' own: the prediction stands beside them.
    own = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], F.lit(0).alias("none")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = predict(own, model).where((F.col("lang_pred") != "und") & ((F.col("score") >= least) | (F.octet_length("text") < LONG_ENOUGH)))
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
