"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window is the set of its word shingles with their positions. Since
a document must contain all of them, it must contain the rarest: windows are
joined to documents on that one prefix token alone, in an order of rarity that
is counted over all documents. The token's place in the window gives the only
start a match can have; starts that would leave the document are discarded,
and the others are verified word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import ALNUM, gram_hashes, lower_ascii, prefix_sums, slices, text_bytes, word_hashes, word_spans
from .repeats import merged

#: Benchmark text that is joined in one pass over the documents.
BLOCK_BYTES = 4 << 20


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    s, e, firsts = word_spans(data, offsets, ALNUM)
    return word_hashes(data, s, e), firsts


class _Windows:
    """Windows of a block of items: word hashes, lengths, and their shingles."""

    def __init__(self, items: list[tuple[list[str], str]], window: int, shingle: int):
        words, firsts = _words(pa.array([t for _, t in items], pa.string()))
        starts, lengths, owner = [], [], []
        for i in range(len(items)):
            n = int(firsts[i + 1] - firsts[i])
            if n:
                k = max(1, n - window + 1)
                starts.append(firsts[i] + np.arange(k))
                lengths.append(np.full(k, min(n, window)))
                owner.append(np.full(k, i))
        cat = lambda c: np.concatenate(c) if c else np.zeros(0, np.int64)
        self.words, self.start, self.length, self.owner = words, cat(starts), cat(lengths), cat(owner)
        self.names = [n for n, _ in items]
        # A window shorter than a shingle is its own shingle.
        self.size = np.minimum(self.length, shingle)
        sums = prefix_sums(words)
        n = self.length - self.size + 1
        self.row = np.repeat(np.arange(len(n)), n)
        self.offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.token = np.zeros(len(self.row), np.uint64)
        for k in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size[self.row] == k)
            self.token[at] = gram_hashes(sums, k)[self.start[self.row[at]] + self.offset[at]]

    def tokens(self) -> dict[int, np.ndarray]:
        """Distinct shingles by their number of words."""
        size = self.size[self.row]
        return {k: np.unique(self.token[size == k]) for k in np.unique(size).tolist()}

    def keep_rarest(self, counts: dict[int, int]) -> None:
        """Leave each window its rarest shingle (the first, of equally rare ones)."""
        often = np.array([counts.get(int(t), 0) for t in self.token.view(np.int64)], np.int64)
        order = np.lexsort((self.offset, often, self.row))
        best = order[np.unique(self.row[order], return_index=True)[1]]
        best = best[np.argsort(self.token[best], kind="stable")]
        self.row, self.offset, self.token = self.row[best], self.offset[best], self.token[best]


def _present(tokens: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Positions of grams that are among the sorted tokens."""
    seen = np.zeros(1 << 16, bool)
    seen[tokens & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(seen[grams & np.uint64(0xFFFF)])
    near = np.minimum(np.searchsorted(tokens, grams[at]), len(tokens) - 1)
    return at[tokens[near] == grams[at]]


def _count(docs: DataFrame, tokens: dict[int, np.ndarray]) -> dict[int, int]:
    """Occurrences of a block's shingles over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        total: dict[int, np.ndarray] = {k: np.zeros(len(t), np.int64) for k, t in held.value.items()}
        for batch in slices(batches, "text"):
            words, firsts = _words(batch.column("text"))
            sums = prefix_sums(words)
            for k, t in held.value.items():
                grams = gram_hashes(sums, k)
                at = _present(t, grams)
                row = np.searchsorted(firsts, at, "right")
                at = at[at + k <= firsts[np.minimum(row, len(firsts) - 1)]]
                total[k] += np.bincount(np.searchsorted(t, grams[at]), minlength=len(t))
        for k, t in held.value.items():
            some = total[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(t[some].view(np.int64)), pa.array(total[k][some])], names=["token", "n"])

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in found}


def _match(words: np.ndarray, firsts: np.ndarray, w: _Windows, sizes: list[int]):
    """(document, first word, last word + 1, window) of each verified occurrence."""
    sums = prefix_sums(words)
    out = [[], [], [], []]
    size = w.size[w.row]
    for k in sizes:
        mine = np.flatnonzero(size == k)
        token = w.token[mine]
        grams = gram_hashes(sums, k)
        at = _present(np.unique(token), grams)
        lo, hi = np.searchsorted(token, grams[at]), np.searchsorted(token, grams[at], "right")
        n = hi - lo
        pick = mine[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        row = w.row[pick]
        doc = np.repeat(np.searchsorted(firsts, at, "right") - 1, n)
        begin = np.repeat(at, n) - w.offset[pick]
        inside = (begin >= firsts[doc]) & (begin + w.length[row] <= firsts[doc + 1])
        row, doc, begin = row[inside], doc[inside], begin[inside]
        for j in range(int(w.length[row].max()) if len(row) else 0):
            here = w.length[row] > j
            ok = ~here
            ok[here] = words[begin[here] + j] == w.words[w.start[row[here]] + j]
            row, doc, begin = row[ok], doc[ok], begin[ok]
        for column, values in zip(out, (doc, begin - firsts[doc], begin - firsts[doc] + w.length[row], row)):
            column.append(values)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


_STATE = "row {row}, text string, n_words long, hits array<struct<start:long,end:long>>, items array<string>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, w: _Windows, row_type: str) -> DataFrame:
    """Add one block's hits and items to every document."""
    held = docs.sparkSession.sparkContext.broadcast((w, np.unique(w.size[w.row]).tolist()))

    def run(batches):
        w, sizes = held.value
        for batch in slices(batches, "text"):
            words, firsts = _words(batch.column("text"))
            doc, start, end, window = _match(words, firsts, w, sizes)
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            order = np.argsort(doc, kind="stable")
            for k in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                i = int(doc[k[0]])
                old = [(h["start"], h["end"]) for h in hits[i]]
                s, e = merged(np.r_[[a for a, _ in old], start[k]].astype(np.int64), np.r_[[b for _, b in old], end[k]].astype(np.int64))
                hits[i] = [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())]
                names = {n for o in np.unique(w.owner[window[k]]).tolist() for n in w.names[o]}
                items[i] = sorted(names | set(items[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(np.diff(firsts)), pa.array(hits, _RUNS), pa.array(items, pa.list_(pa.string()))],
                names=["row", "text", "n_words", "hits", "items"],
            )

    return docs.mapInArrow(run, _STATE.format(row=row_type))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``hits`` and ``items``.

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    A-Z lower-cased. ``hits`` are the maximal runs (first word, end) of words
    inside an occurrence of a window: ``window`` consecutive words of an item,
    or a whole shorter item. ``items`` are the sorted distinct identifiers, as
    strings, of items with such a window. Input columns of these names are
    replaced.

    The benchmark is cut into blocks of about ``block_bytes`` of text; each is
    joined in a pass of its own, so a benchmark of any size needs the memory of
    a block. Null and empty texts, of documents or items, have no words. An
    item without an identifier marks words but is not named; repeated items
    count once, repeated documents stay one for one. An empty table or
    benchmark gives no hits.
    """
    made = ("n_words", "hits", "items")
    rest = [c for c in docs.columns if c not in made]
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    # Repeated texts are one text with several names.
    items = shared.written(items.groupBy("text").agg(F.collect_set("id").alias("ids")), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length(F.concat_ws("", "ids"))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest) if c != text_col], F.lit(0).alias("none")).alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("hits"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    row_type = inner.schema["row"].dataType.simpleString()
    out = inner
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        w = _Windows([(r.ids, r.text) for r in block], window, shingle)
        w.keep_rarest(_count(inner, w.tokens()))
        out = _pass(out, w, row_type)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], *made)


def hit_words(hits: str = "hits"):
    """Number of words that the runs in ``hits`` cover."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without a single benchmark window, columns as they are."""
    return find_contamination(docs, benchmark, **options).where(F.size("hits") == 0).select(*docs.columns)
