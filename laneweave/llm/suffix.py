"""Suffix-array dedup over bytes by prefix-free parsing.

Rolling-hash triggers cut the corpus into phrases. The distinct phrases are the
dictionary and their places, in the order of documents, are the parse. A phrase
goes on for ``window - 1`` bytes after its last start, so no start's first
``window`` bytes leave its phrase: the phrases' suffixes of that length form a
prefix-free set, and corpus order is that of the dictionary's suffix array, with
the parse's order deciding between equal ones. Repetitive text collapses here,
since a phrase that stands earlier in the parse is settled as a whole.

The dictionary's suffixes are sorted block by block (a block has all suffixes
with one range of triggers) to the depth of ``window`` bytes, which is all that
repeats of that length depend on. Neighbours in corpus order that agree so far
are repeats; the first of them is the earliest document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared
from .arrays import changes


def _order(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Rank of the ``window`` bytes from every ``at`` among all of them: equal bytes, equal rank.

    The suffix array of the dictionary, as deep as ``window``: eight bytes at a
    time, going on only with suffixes that still have an equal.
    """
    padded = np.concatenate([data, np.zeros(window + 8, np.uint8)])
    eight = np.ndarray(len(data) + window, ">u8", padded.data, 0, (1,)).astype(np.uint64)
    order = np.argsort(eight)
    new = changes(eight[order])
    word = np.empty(len(order), np.uint64)
    word[order] = np.cumsum(new)
    del eight, order, new
    rank = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for step in [*range(0, window - 8, 8), window - 8]:
        keys = (rank[live].astype(np.uint64) << np.uint64(32)) | word[at[live] + step]
        order = np.argsort(keys)
        keys = keys[order]
        new, group = changes(keys), changes(keys >> np.uint64(32))
        place = np.arange(len(keys))
        first = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank[live[order]] += first
        live = live[order[~(new & np.append(new[1:], True))]]
        if not len(live):
            break
    return rank


def _corpus_order(plan: repeats.Plan, data, edge, base, count, doc, start):
    """Suffixes of a block's phrases in corpus order; those with an equal neighbour of an earlier document are repeats."""
    row = np.repeat(np.arange(len(count)), count)
    shift = np.cumsum(count) - count
    own = np.arange(count.sum()) - shift[row]
    rank = _order(data, base[row] + own, plan.window)
    suffixes = np.lexsort((start[row] + own, doc[row], rank))
    first = changes(rank[suffixes])
    lead = suffixes[np.flatnonzero(first)[np.cumsum(first) - 1]]
    hit = np.zeros(len(row), bool)
    hit[suffixes] = doc[row[lead]] < doc[row[suffixes]]
    goes_on = np.zeros(len(hit), bool)
    goes_on[1:] = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
    begin = np.flatnonzero(hit & ~goes_on)
    end = np.flatnonzero(hit & ~np.append(goes_on[1:], False))
    return row[begin], own[begin], own[end]


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, part_bytes: int = 8 << 20, **tuning) -> DataFrame:
    """Take out every byte that a string of an earlier document covers.

    Texts are UTF-8 bytes. A string of ``window`` bytes is repeated if it also
    starts in a document with a smaller identifier; matches never cross
    documents and all strings are judged on the input. The result has the
    input's columns but ``text_col``, and ``n_bytes``, ``n_removed``,
    ``removed`` (maximal runs as array of start and end byte) and ``kept``
    (binary; a cut may fall within a character). Input columns of these names
    are replaced.

    Null and empty texts have no bytes. A null identifier sorts before all
    others. Rows that share an identifier are one document to this operator:
    they remove nothing from each other and stay one for one. An empty table
    gives an empty result. ``part_bytes`` is the text that one task indexes;
    ``tuning`` sets other bounds of ``repeats.Plan``.
    """
    _, total = shared.text_total(docs, text_col)
    plan = repeats.Plan(window=window, gram=max(4, window // 3), words=False, within=False, parts=shared.part_count(total, part_bytes), **{"piece": 192, **tuning})
    made = ("n_bytes", "n_removed", "removed", "kept")
    rest = [c for c in docs.columns if c != text_col and c not in made]
    inner = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(shared.NULL_ID)).alias("doc"),
        shared.text_tag(text_col).alias("tag"),
        F.col(text_col).alias("text"),
        *[F.col(f"`{c}`").alias(f"rest_{i}") for i, c in enumerate(rest)],
    )
    homed, spans = repeats.find_spans(inner, plan, _corpus_order)

    def cut(text: bytes, start, end):
        kept, at, runs = [], 0, []
        for s, e in zip(start.tolist(), end.tolist()):
            kept.append(text[at:s])
            runs.append({"start": s, "end": e})
            at = e
        kept.append(text[at:])
        kept = b"".join(kept)
        return len(text), len(text) - len(kept), runs, kept

    out = repeats.apply_spans(homed, spans, plan.parts, cut, "n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary", [f"rest_{i}" for i in range(len(rest))])
    return out.select(*[F.col(f"rest_{i}").alias(c) for i, c in enumerate(rest)], *made)
