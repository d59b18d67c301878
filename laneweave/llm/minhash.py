"""MinHash near-dedup by fast similarity sketching.

A set's sketch has ``COORDS`` coordinates. In every round all shingles of a set
are thrown into bins by a hash of the round, and a bin keeps the smallest value
of the first round that hits it. Rounds go on until every bin is filled; what a
small set leaves empty after as many rounds as there are bins gets a round of
its own for each such bin. So every coordinate is filled, two sets agree in a
coordinate with the probability of their Jaccard similarity, and agreements
concentrate as if coordinates were independent, or better.

Bands of ``ROWS`` coordinates deal the sets to buckets. A bucket's members are
verified against its first member on their full sets; what these links join is
settled. Buckets whose members are still apart go on as clusters in which the
full sets of all members decide. Two sets of Jaccard similarity 0.8 share no
bucket with a probability of (1 - 0.8^4)^48, some 10^-11.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, shingles
from .arrays import U64, changes, give_back, mix, slices
from .components import components
from .simhash import grouped

COORDS, ROWS = 192, 4
BANDS = COORDS // ROWS
#: Sets sketched together; smaller ones than this never link with another set (4 of 5 is the least).
_TOGETHER, _LEAST = 2048, 4
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_ROUNDS = mix(np.arange(1, 2 * COORDS + 1, dtype=U64) * U64(0x9E6C63D0876A9A99))
#: Members that one task verifies against a bucket's first member.
LEADER_ROWS = 4096


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketch of each set of shingle hashes, one set after the other with offsets ``at``; sets are not empty."""
    n = len(at) - 1
    out = np.full(n * COORDS, _EMPTY, U64)
    row = np.repeat(np.arange(n), np.diff(at))
    for r in range(COORDS):
        x = mix(h ^ _ROUNDS[r])
        place = row * COORDS + (((x >> U64(32)) * U64(COORDS)) >> U64(32)).astype(np.int64)
        np.minimum.at(out, place, U64(r << 32) | (x & U64(0xFFFFFFFF)))
        open_rows = np.zeros(n, bool)
        live = row[changes(row)] if len(row) else row
        open_rows[live] = (out.reshape(n, COORDS)[live] == _EMPTY).any(axis=1)
        on = open_rows[row]
        h, row = h[on], row[on]
        if not len(row):
            break
    for b in range(COORDS if len(row) else 0):  # a round for each bin that is still empty
        on = out[row * COORDS + b] == _EMPTY
        x = mix(h[on] ^ _ROUNDS[COORDS + b])
        np.minimum.at(out, row[on] * COORDS + b, U64((COORDS + b) << 32) | (x & U64(0xFFFFFFFF)))
    return out.reshape(n, COORDS)


def bands(sketch: np.ndarray) -> np.ndarray:
    """Bucket keys of each sketch, one for a band."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=U64) + U64(77)), (len(sketch), BANDS))
    for r in range(ROWS):
        key = mix(key ^ parts[:, :, r])
    return key


def with_sketch(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The columns in ``keep`` with n_shingles, set_a and set_b (128 bits that stand for the set) and bands.

    Words are split at ASCII white space, A-Z lower-cased; a set has the
    distinct runs of ``shingle`` words, or the whole sequence where there are
    fewer. Null texts and texts without a word have an empty set and no bands,
    and sets too small to link with another have no bands either.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            h, at = shingles.shingle_sets(batch.column("text"), shingle)
            size = np.diff(at)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(s)))]) for s in (0, 0x6A09E667F3BCC908)]
            a, b = (np.ascontiguousarray((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums)
            some = np.flatnonzero(size >= _LEAST)
            keys = []
            for i in range(0, len(some), _TOGETHER):
                rows = some[i : i + _TOGETHER]
                # Sets of too few shingles lie between others: take the shingles of these rows alone.
                mine = np.repeat(at[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(size[rows].sum())
                keys.append(bands(sketches(h[mine], np.r_[0, np.cumsum(size[rows])])).ravel())
            flat = np.concatenate(keys) if keys else np.zeros(0, U64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((size >= _LEAST) * BANDS)].astype(np.int32)), pa.array(np.ascontiguousarray(flat.view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(size.astype(np.int64)), pa.array(a), pa.array(b), lists], names=["row", "n_shingles", "set_a", "set_b", "bands"])

    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, n_shingles long, set_a long, set_b long, bands array<long>")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "n_shingles", "set_a", "set_b", "bands")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the ascending shingle hashes of each node's text."""

    def run(batches):
        for batch in slices(batches, "text"):
            h, at = shingles.shingle_sets(batch.column("text"), shingle)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _led(pairs: DataFrame, sets: DataFrame, leader_rows: int) -> DataFrame:
    """The (leader, node) of ``pairs`` whose full sets link.

    A leader's members are dealt out to as many tasks as they need, each with
    the leader's set; a task holds one leader's set and reads members by batch.
    """
    counts = shared.written(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / leader_rows).cast("int").alias("salts")), "leaders")
    members = pairs.join(counts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "node")
    heads = counts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("leader").alias("node"))
    rows = members.unionByName(heads).join(sets, "node")

    def run(batches):
        of, own = None, np.zeros(0, U64)
        for batch in batches:
            lead, salt, kind, node = (batch.column(c).to_numpy() for c in ("leader", "salt", "kind", "node"))
            raw = batch.column("hashes")
            edge = np.append(np.flatnonzero(changes(lead, salt)), len(lead))
            found = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if kind[lo] == 0:
                    of, own = (lead[lo], salt[lo]), np.frombuffer(raw[lo].as_py(), U64)
                    while lo < hi and kind[lo] == 0:  # a repeated row brings its set again
                        lo += 1
                if lo == hi or of != (lead[hi - 1], salt[hi - 1]):
                    continue
                parts = [np.frombuffer(raw[i].as_py(), U64) for i in range(lo, hi)]
                size = np.array([len(p) for p in parts])
                flat = np.concatenate(parts)
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
                found.append(lo + np.flatnonzero(9 * common >= 4 * (size + len(own))))
            take = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[take]), pa.array(lead[take])], names=["a", "b"])
        give_back()

    return rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind").mapInArrow(run, "a long, b long")


def near_set_links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int, leader_rows: int = LEADER_ROWS, cluster_limit: int = shingles.CLUSTER_LIMIT) -> DataFrame:
    """Edges (a, b) that join all nodes whose sets have a Jaccard similarity of 0.8 or more.

    ``nodes`` is a written table with node, n_shingles and bands; ``texts``
    gives (node, text) of the nodes asked for.
    """
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    # Counted first, so that a bucket of very many sets is a join's hot key, which can be split, and not a window.
    buckets = shared.written(dealt.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader"), "buckets")
    members = shared.written(dealt.join(buckets, "bucket").select("bucket", "leader", "node"), "members")
    wanted = shared.written(members.select("node").distinct(), "wanted")
    sets = shared.written(_sets(texts(wanted), shingle), "sets")
    sizes = nodes.select("node", F.col("n_shingles").alias("n"))
    pairs = members.where("node <> leader").select("leader", "node").distinct()
    pairs = pairs.join(sizes, "node").join(sizes.withColumnsRenamed({"node": "leader", "n": "m"}), "leader")
    pairs = shared.written(pairs.where("5 * least(n, m) >= 4 * greatest(n, m)").select("leader", "node"), "pairs")
    edges = shared.written(_led(pairs, sets, leader_rows), "edges")
    # Buckets whose members are joined are settled; the members of the others meet in clusters.
    roots = components(edges)
    rooted = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    apart = shared.written(rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("leader")).where("low <> high").select("bucket", "leader"), "apart")
    if apart.isEmpty():
        return edges
    rest = members.select("bucket", "node").join(apart, "bucket").where("node <> leader").select("leader", "node").distinct()
    clusters = components(rest)
    tops = clusters.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    placed = shared.written(clusters.unionByName(tops).distinct().join(sizes, "node"), "placed")
    large = shared.written(placed.groupBy("root").agg(F.sum("n").alias("shingles")), "clusters")
    total = int(large.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0])

    def compare(table: pa.Table) -> np.ndarray:
        own = [np.frombuffer(x, U64) for x in table["hashes"].to_pylist()]
        return shingles.near_sets(np.concatenate(own), np.r_[0, np.cumsum([len(s) for s in own])])

    rows = placed.select("node", "root").join(sets, "node").join(large, "root").select("root", "node", "hashes", "shingles")
    more = shingles.dealt_edges(rows, "root", F.ceil(F.col("shingles") / cluster_limit).cast("int"), 4_000_000, total, compare)
    return edges.unionByName(more)


def near_set_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, **limits) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: one row for each, near copies under one component.

    Two rows link if their sets of ``shingle``-word runs have a Jaccard
    similarity of 0.8 or more, which is confirmed on the full sets; a component
    has the smallest identifier that links reach, and the row of that
    identifier is ``kept``. Rows with equal sets are one node, so copies are
    never paired. Null and empty texts and texts without a word link with
    nothing and keep their own identifier. A null identifier names no
    component: a component of such rows only has a null id, and they are kept.
    Repeated rows stay one for one. An empty table gives an empty result.
    """
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), shared.text_tag(text_col).alias("tag"), F.col(f"`{text_col}`").alias("text"))
    marks = shared.written(with_sketch(inner, ["id", "tag"], "text", shingle), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first")
    sets = marks.where("n_shingles > 0").groupBy(*key).agg(F.min("id").alias("first_id"), first, F.first("bands").alias("bands"))
    # Numbered when written: no hash stands for a node from here on.
    nodes = shared.written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    reps = nodes.where("size(bands) > 0").select("node", F.col("first.id").alias("__id"), F.col("first.tag").alias("__tag"))

    def texts(wanted: DataFrame) -> DataFrame:
        return inner.join(reps.join(wanted, "node"), inner["id"].eqNullSafe(F.col("__id")) & (inner["tag"] == F.col("__tag"))).select("node", "text")

    edges = near_set_links(nodes, texts, shingle, **limits)
    # Written, so that the join of all rows has only exchanges under it and a set of very many copies can be split.
    named = shared.written(grouped(nodes.select(*key, "node", "first_id"), F.col("node"), nodes.select("node", "first_id"), edges).select(*key, "component_id"), "named")
    linked = marks.where("n_shingles > 0").select("id", *key).join(named, key)
    alone = marks.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.select("id", "n_shingles", "component_id").unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
