"""Links between documents whose shingle sets are alike, all of them, at every size of input.

Candidates come from a prefix-filtered join: of each set's shingles in one
global order, rare ones first, so many are its prefix that two sets of Jaccard
4/5 or more must share one. Sets with a common prefix shingle are a group, in
which SimHash fingerprints of 256 bits are compared as ``simhash.link_group``
does: distances to reference fingerprints discard pairs, bits decide on the
rest. What is left clusters, and within a cluster the sets themselves decide.

Sets of Jaccard 4/5 differ in 39 bits of 256 on average (48 where they have
five members), with a deviation of 6, so a bound of ``MAX_BITS`` loses one pair
in some ten million; unrelated sets differ in 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared, simhash
from .arrays import SPACED, U64, changes, give_back, lower_ascii, mix, prefix_sums, run_hash, slices, text_bytes, word_hashes, word_spans
from .components import components

#: Sets link from a Jaccard similarity of 4/5 on: 9 * common >= 4 * (one + other).
#: Bits in which fingerprints of sets that link may differ, of WORDS times 64.
MAX_BITS, WORDS = 80, 4
#: Sets of a candidate group, and shingles of a cluster, that one task compares; larger ones are dealt out as pairs of chunks.
GROUP_LIMIT, CLUSTER_LIMIT = 30_000, 1_000_000
MARKS = [f"mark_{j}" for j in range(WORDS)]
#: Places of the table of common shingles, and how many of them a task and all tasks report.
_PLACES, _TASK_MOST, _MOST = 1 << 20, 2_048, 16_384


def _shingles(column, shingle: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and row of every shingle, and the number of rows.

    Words are split at ASCII white space, A-Z lower-cased; a shorter text is one shingle.
    """
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    s, e, firsts = word_spans(data, offsets, SPACED)
    n = np.diff(firsts)
    count = np.maximum(n - shingle + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + firsts[:-1][row]
    return run_hash(prefix_sums(word_hashes(data, s, e)), start, np.minimum(n, shingle)[row]), row, len(n)


def shingle_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, one row after the other, and the rows' offsets."""
    h, row, n = _shingles(column, shingle)
    # The row leads the sort key in place of the lowest bits; equal keys of one row are put right below.
    shift = U64(max(1, int(n).bit_length()))
    order = np.argsort((row.astype(U64) << (U64(64) - shift)) | (h >> shift))
    row, h = row[order], h[order]
    late = np.flatnonzero((h[1:] < h[:-1]) & (row[1:] == row[:-1]))
    if len(late):
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
    new = changes(row, h)
    return h[new], np.searchsorted(row[new], np.arange(n + 1))


def _prefixes(h: np.ndarray, at: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set's prefix and their number: uncommon ones by hash, then common ones by ``often`` and hash."""
    size = np.diff(at)
    prefix = size - (4 * size + 4) // 5 + (size > 0)
    row = np.repeat(np.arange(len(size)), size)
    rare = often == 0
    before = np.cumsum(rare) - rare
    nth = before - np.append(before, rare.sum())[at[:-1]][row]
    take = rare & (nth < prefix[row])
    short = np.flatnonzero(np.bincount(row[take], minlength=len(size)) < prefix)
    for i in short.tolist():
        own = slice(at[i], at[i + 1])
        take[own] = False
        take[at[i] + np.lexsort((h[own], often[own]))[: prefix[i]]] = True
    return h[take], prefix


def _common(docs: DataFrame, shingle: int) -> dict[int, int]:
    """Counts at the places of the most common shingles, about; only the order of prefixes follows from them."""

    def run(batches):
        total = np.zeros(_PLACES, np.int64)
        for batch in slices(batches, "text"):
            h, _, _ = _shingles(batch.column("text"), shingle)
            total += np.bincount((h >> U64(44)).astype(np.int64), minlength=_PLACES)
        most = np.argsort(-total, kind="stable")[:_TASK_MOST]
        most = most[total[most] > 8]
        yield pa.RecordBatch.from_arrays([pa.array(most), pa.array(total[most])], names=["place", "n"])

    found = docs.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    return {r.place: r.n for r in found.orderBy(F.desc("n"), "place").limit(_MOST).collect()}


def with_shingle_marks(docs: DataFrame, keep: list[str], text_col: str, shingle: int) -> DataFrame:
    """The columns in ``keep`` with node (hash of the set), size, prefix and the fingerprint's words."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    common = np.zeros(_PLACES, np.int32)
    found = _common(inner.select("text"), shingle)
    common[list(found)] = list(found.values())
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in slices(batches, "text"):
            h, at = shingle_sets(batch.column("text"), shingle)
            size = np.diff(at)
            sums = np.zeros(len(h) + 1, U64)
            np.cumsum(mix(h), out=sums[1:])
            node = mix(sums[at[1:]] - sums[at[:-1]] + size.astype(U64)).view(np.int64)
            marks = simhash.votes(mix(h), size, WORDS).view(np.int64)
            token, prefix = _prefixes(h, at, held.value[(h >> U64(44)).astype(np.int64)])
            token = token.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(prefix)].astype(np.int32)), pa.array(token))
            columns = [batch.column("row"), pa.array(node), pa.array(size.astype(np.int64)), lists, *[pa.array(np.ascontiguousarray(marks[:, j])) for j in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "node", "size", "prefix", *MARKS])

    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, node long, size long, prefix array<long>, " + ", ".join(f"{m} long" for m in MARKS))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "node", "size", "prefix", *MARKS)


def _merge(label: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One label, the smallest, for everything that has a label of ``rows``."""
    own = np.unique(label[rows])
    return label if len(own) < 2 else np.where(np.isin(label, own), own[0], label)


def _outside(label: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rows that are not seen yet and not in the largest component; links between components have one of them or a seen one."""
    names, counts = np.unique(label, return_counts=True)
    return np.flatnonzero((label != names[counts.argmax()]) & ~seen)


def _settled(n: int, near) -> np.ndarray:
    """Component of each of n rows; ``near(i)`` gives all rows that link with row i."""
    label, seen = np.arange(n), np.zeros(n, bool)
    for i in np.linspace(0, n - 1, min(n, 8)).astype(int).tolist():
        if not seen[i]:
            label, seen[i] = _merge(label, np.append(near(i), i)), True
    left = _outside(label, seen)
    while len(left):
        for i in left[:256].tolist():
            label, seen[i] = _merge(label, np.append(near(i), i)), True
        left = _outside(label, seen)
    return label


def near_sets(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Components of the sets that link, by their common shingles."""
    n, size = len(offsets) - 1, np.diff(offsets)
    _, token = np.unique(h, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    first = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))

    def near(i: int) -> np.ndarray:
        t = token[offsets[i] : offsets[i + 1]]
        many = first[t + 1] - first[t]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[t], many)
        return np.flatnonzero(9 * np.bincount(owner[at], minlength=n) >= 4 * (size + size[i]))

    return _settled(n, near)


def dealt_edges(rows: DataFrame, key: str, chunks: Column, part_rows: int, n: int, compare) -> DataFrame:
    """Edges (a, b) of the groups of rows with one key; a group of several chunks meets as pairs of them."""
    columns = [c for c in rows.columns if c != key]
    rows = rows.withColumn("chunks", chunks)
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")), lambda c: F.struct(F.least(own, c).alias("i"), F.greatest(own, c).alias("j")))
    spread = rows.select(*columns, F.col(key).alias("k"), F.explode(pairs).alias("c")).select("k", "c.i", "c.j", *columns)
    parts = shared.part_count(n, part_rows)
    keyed = spread.select(F.pmod(F.xxhash64("k", "i", "j"), F.lit(parts)).cast("int").alias("part"), "k", "i", "j", *columns)

    def edges(table: pa.Table) -> pa.RecordBatch:
        cut = np.flatnonzero(changes(*[table[c].to_numpy() for c in ("k", "i", "j")]))
        ids = table["node"].to_numpy()
        out = []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
            if hi - lo > 1:
                label = compare(table.slice(lo, hi - lo))
                moved = np.flatnonzero(label != np.arange(hi - lo))
                out.append((ids[lo:hi][moved], ids[lo:hi][label[moved]]))
        a, b = (np.concatenate([o[x] for o in out]) if out else np.zeros(0, np.int64) for x in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:  # sorted by group: the last one may still grow
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = int(np.flatnonzero(changes(*[held[c].to_numpy() for c in ("k", "i", "j")]))[-1]) if held.num_rows else 0
            if last:
                yield edges(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield edges(held)
        give_back()

    return keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("k", "i", "j", "node").mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) that hold together all sets that may link."""
    tokens = nodes.select("node", F.explode("prefix").alias("token"))
    # Shingles that the same sets share make one group. In a window, so that the tokens move once and are never written.
    of = W.partitionBy("token")
    groups = tokens.select("node", F.count(F.lit(1)).over(of).alias("n"), F.bit_xor(F.xxhash64("node")).over(of).alias("key"))
    members = shared.written(groups.where("n > 1").select("key", "node").distinct(), "members")
    sizes = shared.written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n = members.count()
    rows = members.join(sizes, "key").join(nodes.select("node", "size", *MARKS), "node").select("key", "node", "n", "size", *MARKS)

    def compare(table: pa.Table) -> np.ndarray:
        words = np.stack([table[m].to_numpy() for m in MARKS], axis=1).view(U64)
        return simhash.link_group(words, MAX_BITS, table["size"].to_numpy())

    return dealt_edges(rows, "key", F.ceil(F.col("n") / group_limit).cast("int"), 50_000, n, compare)


def verified(texts: DataFrame, clusters: DataFrame, shingle: int, cluster_limit: int = CLUSTER_LIMIT) -> DataFrame:
    """Edges (a, b) between the sets of a cluster that link; ``texts`` has node, root and text, ``clusters`` root and shingles."""

    def run(batches):
        for batch in slices(batches, "text"):
            h, at = shingle_sets(batch.column("text"), shingle)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=["root", "node", "hashes"])

    def compare(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x, U64) for x in table["hashes"].to_pylist()]
        return near_sets(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])

    sets = texts.select("root", "node", "text").mapInArrow(run, "root long, node long, hashes binary")
    total = clusters.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    rows = sets.join(clusters, "root")
    return dealt_edges(rows, "root", F.ceil(F.col("shingles") / cluster_limit).cast("int"), 4_000_000, int(total), compare)


def near_copy_links(docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Edges (a, b) between the nodes whose sets have a Jaccard similarity of 4/5 or more.

    ``nodes`` has every node once with ``first`` (id and tag of one of its
    documents); ``docs`` has id, tag and the text.
    """
    roots = shared.written(components(candidates(nodes)).withColumnRenamed("root", "r"), "roots")
    tops = roots.select(F.col("r").alias("node")).distinct().withColumn("r", F.col("node"))
    placed = shared.written(nodes.join(roots.unionByName(tops).distinct(), "node").select("node", "size", "first", F.col("r").alias("root")), "placed")
    clusters = shared.written(placed.groupBy("root").agg(F.sum("size").alias("shingles")), "clusters")
    reps = placed.select("node", "root", F.col("first.id").alias("__id"), F.col("first.tag").alias("__of"))
    texts = docs.join(reps, docs["id"].eqNullSafe(F.col("__id")) & (docs["tag"] == F.col("__of"))).select("node", "root", F.col(text_col).alias("text"))
    return verified(texts, clusters, shingle)
