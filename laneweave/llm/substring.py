"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference. Its distinct passages lie in blocks, one per
range of trigger hashes, each indexed by the hash chains of its runs of
``window`` words. Passages are parsed greedily against every block that can
hold a match of ``window`` words: at a position the index gives the earliest
such run, the words decide, and the match is extended as far as the source
goes on. This factor becomes a duplicate span. Parsing goes on at the first
start that the factor does not hold as a whole, ``window - 1`` words before its
end, so windows that straddle the boundary of two factors are tried too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared
from .arrays import changes, prefix_sums, run_hash, word_hashes


class ReferenceBlock:
    """Passages of a block, and the index of their runs of ``window`` words."""

    def __init__(self, data, edge, base, count, doc, start, window: int):
        self.data, self.edge, self.base, self.count, self.doc, self.start, self.window = data, edge, base, count, doc, start, window
        self.sums = prefix_sums(word_hashes(data, edge[:-1], edge[1:] - 1))
        row = np.repeat(np.arange(len(count)), count)
        own = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        h = run_hash(self.sums, base[row] + own, window)
        # Chains of equal hashes, the earliest start at the head of each.
        order = np.lexsort((start[row] + own, doc[row], h))
        head = order[changes(h[order])]
        self.hash, self.head_row, self.head_own = h[head], row[head], own[head]

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, first word and length of every factor of ``window`` words or more with an earlier source."""
        w = self.window
        size = self.count + w - 1
        out = []
        row, at = np.arange(len(self.count)), np.zeros(len(self.count), np.int64)
        while len(row):  # all passages take their next step together
            place = self.base[row] + at
            h = run_hash(self.sums, place, w)
            k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            source, s_at = self.head_row[k], self.head_own[k]
            s_doc, s_start = self.doc[source], self.start[source] + s_at
            hit = (self.hash[k] == h) & ((s_doc < self.doc[row]) | ((s_doc == self.doc[row]) & (s_start < self.start[row] + at)))
            hit[hit] = self._same(place[hit], (self.base[source] + s_at)[hit], np.full(int(hit.sum()), w))
            step = np.ones(len(row), np.int64)
            if hit.any():
                a, b = place[hit], (self.base[source] + s_at)[hit]
                most = np.minimum(size[row[hit]] - at[hit], size[source[hit]] - s_at[hit])
                length = self._extended(a, b, most)
                out.append((row[hit], at[hit], length))
                step[hit] = length - w + 1
            at = at + step
            left = at < self.count[row]
            row, at = row[left], at[left]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def _same(self, a, b, n):
        """Whether the n words from a are those from b."""
        bytes_a, bytes_b = self.edge[a + n] - self.edge[a], self.edge[b + n] - self.edge[b]
        out = bytes_a == bytes_b
        out[out] = repeats.equal_bytes(self.data, self.edge[a[out]], self.edge[b[out]], bytes_a[out])
        return out

    def _extended(self, a, b, most):
        """Words from a and b that agree, ``window`` at least, ``most`` at most: by halving over hashes, then the words."""
        low, high = np.full(len(a), self.window), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = run_hash(self.sums, a, middle) == run_hash(self.sums, b, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return np.where(self._same(a, b, low), low, self.window)


def _factor(plan: repeats.Plan, data, edge, base, count, doc, start):
    piece, first, length = ReferenceBlock(data, edge, base, count, doc, start, plan.window).factors()
    return piece, first, first + length - plan.window


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, respace: bool = False, part_bytes: int = 8 << 20, **tuning) -> DataFrame:
    """Take out every word that a repeated window of ``window`` words covers.

    Words are split at ASCII white space. A window is repeated if its words
    also start earlier: in a document with a smaller identifier, or earlier in
    the same one; all windows are judged on the input. The result has the
    input's columns, with the kept words in ``text_col``, and ``n_words`` and
    ``n_removed`` (input columns of these names are replaced). A text of which
    nothing is removed stays as it is unless ``respace`` joins its words by one
    space, as it does where words were removed.

    Null and empty texts have no words and come back empty. A null identifier
    sorts before all others. Rows that share an identifier count as one
    document in the order of starts, so an identical repeated row removes
    nothing from itself; rows are kept one for one. An empty table gives an
    empty result. ``part_bytes`` is the text that one task indexes at a time;
    ``tuning`` sets other bounds of ``repeats.Plan``.
    """
    _, total = shared.text_total(docs, text_col)
    plan = repeats.Plan(window=window, gram=window // 2, words=True, within=True, parts=shared.part_count(total, part_bytes), **{"piece": 48, **tuning})
    made = ("n_words", "n_removed", "kept_text")
    rest = [c for c in docs.columns if c != text_col and c not in made]
    inner = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(shared.NULL_ID)).alias("doc"),
        shared.text_tag(text_col).alias("tag"),
        F.col(text_col).alias("text"),
        *[F.col(f"`{c}`").alias(f"rest_{i}") for i, c in enumerate(rest)],
    )
    homed, spans = repeats.find_spans(inner, plan, _factor)

    def cut(text: bytes, start, end):
        words = text.split()
        if not len(start):
            return len(words), 0, (b" ".join(words) if respace else text).decode("utf-8")
        kept, at = [], 0
        for s, e in zip(start.tolist(), end.tolist()):
            kept += words[at:s]
            at = e
        kept += words[at:]
        return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")

    out = repeats.apply_spans(homed, spans, plan.parts, cut, "n_words long, n_removed long, kept_text string", [f"rest_{i}" for i in range(len(rest))])
    columns = [F.col("kept_text").alias(c) if c == text_col else F.col(f"rest_{rest.index(c)}").alias(c) for c in docs.columns if c not in made or c == text_col]
    return out.select(*columns, "n_words", "n_removed")
