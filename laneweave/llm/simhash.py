"""SimHash near-dedup with pivot distance tables.

Texts become 64-bit fingerprints. Fingerprints within ``max_bits`` of each
other agree exactly in some of the blocks that the 64 bits are cut into, which
deals the corpus out to small groups. In a group, every fingerprint's Hamming
distances to a set of reference fingerprints are tabulated; by the triangle
inequality two that link differ by at most ``max_bits`` in every coordinate,
so pairs with a larger difference in any are discarded, and the survivors are
verified bit by bit.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, shingles
from .arrays import U64, changes, give_back, mix, slices, text_bytes
from .components import components

#: Reference fingerprints.
PIVOTS = mix(np.arange(101, 109, dtype=U64))
#: Fingerprints of a group that one task compares; a larger group is dealt out as pairs of its chunks.
GROUP_LIMIT = 60_000


def votes(hashes: np.ndarray, n: np.ndarray, words: int = 1) -> np.ndarray:
    """Majority vote of hash bits for many texts at once: ``words`` times 64 bits for each.

    ``n`` hashes belong to each text, one text after the other; none leaves 0.
    Every further word votes on bits that are mixed anew from the hash.
    """
    out = np.zeros((len(n), words), U64)
    full = n > 0
    if not full.any():
        return out
    n = n[full].astype(np.int64)
    # Eight counters of a byte each in a word: runs of 255 at most, then their sums.
    runs = -(-n // 255)
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    at = np.repeat(np.cumsum(n) - n, runs) + within * 255
    for j in range(words):
        h = mix(hashes + U64(j * 0x9E6C63D0876A9A99 & 0xFFFFFFFFFFFFFFFF)) if j else hashes
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(U64)
        sums = np.add.reduceat(bits, at, axis=0).view(np.uint8).astype(np.uint32)
        sums = np.add.reduceat(sums, np.cumsum(runs) - runs, axis=0)
        out[full, j] = np.packbits((2 * sums > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """Majority vote of the shingles' XXH64 bits; a long text is hashed and counted piece by piece."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        split = text.lower().split()
        n = len(split)
        counts.append(max(n - shingle + 1, min(n, 1)))
        if not n:
            continue
        joined = b" ".join(split)
        if n <= shingle:
            hashes.append(digest(joined, 42))
            continue
        starts = [0, *accumulate(len(w) + 1 for w in split)]
        hashes += [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])]
    return votes(np.array(hashes, U64), np.array(counts, np.int64))[:, 0]


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 4, name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: all) and a long of the 64 fingerprint bits.

    Words are split at ASCII white space, A-Z lower-cased; a shingle is
    ``shingle`` words joined by one space, repeats counted; a shorter text is
    one shingle. Null texts and texts without a word get 0. A bit is set if it
    is set in more than half of the shingles' XXH64 (seed 42).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    inner = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            data = data.tobytes()
            got = _fingerprints([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], shingle)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got.view(np.int64))], names=["row", "mark"])

    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, mark long")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], F.col("mark").alias(name))


def _tables(max_bits: int, n: int, group: int = 4096, most: int = 100) -> list[int]:
    """Bit masks such that fingerprints within ``max_bits`` agree under one.

    64 bits in max_bits + g blocks: at least g agree. g grows until n
    fingerprints spread into groups of about ``group``, or as long as the
    masks are not more than ``most``.
    """
    found: list[int] = []
    for g in range(1, 5):
        blocks = max_bits + g
        if found and comb(blocks, g) > most:
            break
        edges = [64 * i // blocks for i in range(blocks + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        found = [sum(pick) for pick in combinations(masks, g)]
        if n >> (g * (64 // blocks)) <= group:
            break
    return found


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label along the links i-j."""
    a, b = label[i], label[j]
    apart = a != b
    a, b = a[apart], b[apart]
    root = np.arange(len(label))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root[label]


class _Group:
    """Fingerprints of a group with their distances to reference fingerprints.

    Fixed references serve fingerprints of 64 bits. The bounds of longer ones
    are too wide for these, as all distances to a random reference are nearly
    alike; members of the group are their references, to which one cluster is
    near and the others are far.
    """

    def __init__(self, words: np.ndarray, max_bits: int, sizes: np.ndarray | None = None):
        self.words, self.max_bits, self.sizes = words, max_bits, sizes
        references = PIVOTS[:, None] if words.shape[1] == 1 else words[np.unique(np.linspace(0, len(words) - 1, len(PIVOTS)).astype(int))]
        self.table = np.stack([np.bitwise_count(words ^ r).sum(axis=1, dtype=np.int16) for r in references], axis=1)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs link, bit by bit; sizes must be within 4/5 of each other."""
        ok = np.bitwise_count(self.words[i] ^ self.words[j]).sum(axis=1, dtype=np.int16) <= self.max_bits
        if self.sizes is not None:
            a, b = self.sizes[i], self.sizes[j]
            ok &= 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
        return ok

    def linked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs between two runs of rows: pivot tables first, then the survivors' bits."""
        ta, tb = self.table[a], self.table[b]
        pairs = np.ones((len(a), len(b)), bool)
        for c in range(ta.shape[1]):
            pairs &= np.abs(ta[:, c, None] - tb[None, :, c]) <= self.max_bits
        at = np.flatnonzero(pairs)
        i, j = a[at // len(b)], b[at % len(b)]
        ok = self.near(i, j)
        return i[ok], j[ok]


def link_group(words: np.ndarray, max_bits: int, sizes: np.ndarray | None = None, tile: int = 1024) -> np.ndarray:
    """Component label (a row number) of each fingerprint of a group."""
    n = len(words)
    group = _Group(words, max_bits, sizes)
    label, every = np.arange(n), np.arange(n)
    if n <= tile:
        return _settle(label, *group.linked(every, every))
    # Dense clusters first: what lies within reach of one member needs no pair of its own.
    # These rounds compare every row with one, so the tables have nothing to discard yet.
    for _ in range(32):
        own = np.flatnonzero(label == every)
        seed = np.full(n, own[len(own) // 2])
        near = np.flatnonzero(group.near(seed, every))
        label = _settle(label, seed[near], near)
    order = np.argsort(label, kind="stable")
    for a in range(0, n, tile):
        for b in range(a, n, tile):
            ra, rb = order[a : a + tile], order[b : b + tile]
            if label[ra].min() == label[ra].max() == label[rb].min() == label[rb].max():
                continue
            label = _settle(label, *group.linked(ra, rb))
    return label


def links(nodes: DataFrame, max_bits: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) that join the ids of all fingerprints that link.

    ``nodes`` has a long id first, then the fingerprint. Two link if they
    differ in at most ``max_bits`` bits. Each group yields a star per
    component, never all its pairs.
    """
    node_id, name = nodes.columns
    plain = nodes.select(F.col(node_id).alias("id"), F.col(name).alias("w"))
    n = plain.count()
    masks = [m - (1 << 64) if m >> 63 else m for m in _tables(max_bits, n)]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("w").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    dealt = plain.select("id", "w", F.explode(tables).alias("g")).select("id", "w", "g.t", "g.k")
    large = dealt.groupBy("t", "k").count().where(F.col("count") > group_limit).select("t", "k", F.ceil(F.col("count") / group_limit).cast("int").alias("chunks"))
    spread = dealt.join(large, ["t", "k"], "left").withColumn("own", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
    # A chunk of a large group meets each of the others once.
    pairs = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least("own", c).alias("i"), F.greatest("own", c).alias("j")))
    )
    spread = spread.select("id", "w", "t", "k", F.explode(pairs).alias("c")).select("id", "w", "t", "k", "c.i", "c.j")
    parts = shared.part_count(n * len(masks), 150_000)
    keyed = spread.select(F.pmod(F.xxhash64("t", "k", "i", "j"), F.lit(parts)).cast("int").alias("part"), "id", "w", "t", "k", "i", "j")

    def run(batches):
        held = None

        def edges(rows):
            t, k, i, j, ids, w = rows
            cut = np.flatnonzero(changes(t, k, i, j))
            matrix = w.view(U64)[:, None]
            out = []
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
                if hi - lo > 1:
                    own = ids[lo:hi]
                    label = link_group(matrix[lo:hi], max_bits)
                    moved = np.flatnonzero(label != np.arange(len(own)))
                    if len(moved):
                        out.append((own[moved], own[label[moved]]))
            a = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)
            b = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:  # sorted by group: the last one may still grow
            rows = [batch.column(c).to_numpy() for c in ("t", "k", "i", "j", "id", "w")]
            held = rows if held is None else [np.concatenate(p) for p in zip(held, rows)]
            last = np.flatnonzero(changes(*held[:4]))[-1]
            if last:
                yield edges([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield edges(held)
        give_back()

    return keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("t", "k", "i", "j", "id").mapInArrow(run, "a long, b long")


def near_duplicate_groups(marks: DataFrame, id_col: str = "doc_id", name: str = "fingerprint", max_bits: int = 4) -> DataFrame:
    """``marks`` (identifier and fingerprint of every row) with ``component_id``.

    Two rows link if their fingerprints differ in at most ``max_bits`` bits;
    the component's id is the smallest identifier in reach. Rows with equal
    fingerprints are one node, so copies are never paired. Null identifiers
    name no component: one of only such rows has a null id. Repeated rows stay
    one for one; an empty table gives an empty result.
    """
    node = F.col(f"`{name}`")
    nodes = shared.written(marks.groupBy(node.alias("node")).agg(F.min(F.col(f"`{id_col}`")).alias("first_id")), "nodes")
    return grouped(marks, node, nodes, links(nodes.select("node", F.col("node").alias("mark")), max_bits))


def grouped(marks: DataFrame, node: Column, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``marks`` with the ``component_id`` that follows from edges between their nodes."""
    roots = components(edges)
    placed = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    # Written, so that the join by root has only exchanges under it and a large component can be split.
    named = shared.written(placed.groupBy("root").agg(F.min("first_id").alias("__component")), "components")
    of_mark = placed.join(named, "root").select(F.col("node").alias("__node"), "__component")
    rest = [c for c in marks.columns if c != "component_id"]
    joined = marks.select(*rest).withColumn("__of", node).join(of_mark, F.col("__of") == F.col("__node"))
    return joined.select(*rest, F.col("__component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One document of every near-duplicate group, that with the smallest identifier.

    Documents link if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more: pairs with a rare shingle in common whose
    fingerprints of 256 bits are near each other, by reference fingerprints and
    then bit by bit, and whose sets are verified (see ``shingles``). Columns
    stay as they are, clashing names too. Texts that are null, empty or without
    a word are alike. A null identifier comes last in its group. Of rows that
    repeat the kept identifier and text, one stays. An empty table gives an
    empty result.
    """
    keyed = docs.withColumn("__tag", shared.text_tag(text_col))
    marks = shared.written(shingles.with_shingle_marks(keyed, [id_col, "__tag"], text_col, shingle), "marks")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__tag").alias("tag"))).alias("first")
    # Equal hash, size and 256 fingerprint bits are one set; nodes are numbered when written, so no hash stands for one from here on.
    key = ["node", "size", *shingles.MARKS]
    sets = marks.groupBy(*key).agg(F.min(id_col).alias("first_id"), first, F.first("prefix").alias("prefix"))
    numbered = shared.written(sets.withColumn("number", F.monotonically_increasing_id()), "nodes")
    nodes = numbered.drop("node").withColumnRenamed("number", "node")
    texts = keyed.select(F.col(id_col).alias("id"), F.col("__tag").alias("tag"), text_col)
    edges = shingles.near_copy_links(texts, nodes, text_col, shingle)
    placed = marks.select(id_col, "__tag", *key).join(numbered.select(*key, "number"), key).select(id_col, "__tag", F.col("number").alias("node"))
    groups = grouped(placed, F.col("node"), nodes, edges)
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__tag").alias("tag"))).alias("best"))
    keep = best.select(F.col("best.id").alias("__id"), F.col("best.tag").alias("__of"))
    kept = keyed.join(keep, keyed[id_col].eqNullSafe(F.col("__id")) & (keyed["__tag"] == F.col("__of")), "left_semi")
    return kept.dropDuplicates([id_col, "__tag"]).drop("__tag")
