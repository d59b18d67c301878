"""How far the sources of a language differ in their words.

A group is a language's source. Its terms are a sparse row of counts; the
divergence of two groups is a sum over all kept terms of the language, nearly
all of which at least one of the two lacks. Gustavson's way of multiplying
sparse matrices serves it: for each group, its terms are looked up in an index
that has the groups of every term side by side, and what the term adds goes
into a dense accumulator with a place for each peer. Pairs of postings are never
rows. An accumulator starts from what the two groups would have in common if
neither had any term of the other, which follows from the histogram of a
group's counts, and terms that both have correct it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .arrays import byte_class, changes, give_back, lower_ascii, slices, text_bytes, word_spans

#: Terms: runs of ASCII letters and non-ASCII bytes.
LETTERS = byte_class([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Shares are whole numbers of this part.
UNIT = 1_000_000_000
#: Counted terms that a task holds before it sends them, and postings that one task indexes.
TERMS_HELD, INDEX_ROWS = 200_000, 200_000


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a slice; a group's row without a term says that it occurs."""
    data, offsets = text_bytes(batch.column("text"))
    data = lower_ascii(data)
    s, e, firsts = word_spans(data, offsets, LETTERS)
    size = e - s
    letters = data[LETTERS[data]]
    langs, sources = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
    pair = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
    pairs, of = np.unique(pair, return_inverse=True)
    names = [langs.dictionary.take(pa.array(pairs // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(pairs % max(1, len(sources.dictionary))))]
    here = [*names, pa.nulls(len(pairs), pa.string()), pa.array(np.zeros(len(pairs), np.int64)), pa.array(np.zeros(len(pairs), np.int64))]
    out = [pa.table(here, names=["lang", "source", "term", "n", "docs"])]
    if len(s):
        # Bytes decide which words are equal: the library's dictionary, not a hash of ours.
        words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(letters)])
        coded = pc.dictionary_encode(words)
        code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        row = np.repeat(np.arange(len(of)), np.diff(firsts))
        cells, n = np.unique(row * many + code, return_counts=True)
        keys, back = np.unique(of[cells // many] * many + cells % many, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, n)
        terms = coded.dictionary.take(pa.array(keys % many)).cast(pa.large_string()).cast(pa.string())
        out.append(pa.table([names[0].take(pa.array(keys // many)), names[1].take(pa.array(keys // many)), terms, pa.array(total), pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64))], names=["lang", "source", "term", "n", "docs"]))
    return pa.concat_tables(out)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a null term for each group as such."""
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    key = ["lang", "source", "term"]

    def run(batches):
        held: pa.Table | None = None
        for batch in slices(batches, "text"):
            made = _counted(batch)
            held = made if held is None else pa.concat_tables([held, made])
            if held.num_rows > TERMS_HELD:
                held = held.group_by(key).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*key, "n", "docs"])
                if held.num_rows > TERMS_HELD // 2:
                    yield from held.to_batches(max_chunksize=50_000)
                    held = None
        if held is not None:
            yield from held.group_by(key).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*key, "n", "docs"]).to_batches(max_chunksize=50_000)
        give_back()

    found = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # Dealt out by term: the count of its documents over all sources then needs no further exchange.
    return found.repartition("lang", "term").groupBy(*key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> F.Column:
    """1 + floor(UNIT * (n + 1) / (total + V)) in whole numbers."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} + V as decimal(20,0))")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _both(postings: DataFrame, parts: int) -> DataFrame:
    """(lang, own, peer, value): corrections for the terms that two groups share, added up in each task.

    ``postings`` has lang, term, own (the group's number), p and p0 (its share
    for the term, and for a term that it lacks).
    """

    def run(batches):
        got: dict[str, list] = {"lang": [], "term": [], "own": [], "p": [], "p0": []}
        for batch in batches:  # as many as one task indexes
            for c in got:
                got[c].append(batch.column(c))
        if not got["lang"]:
            return
        langs = pc.dictionary_encode(pa.chunked_array(got["lang"])).unify_dictionaries().combine_chunks()
        terms = pc.dictionary_encode(pa.chunked_array(got["term"])).unify_dictionaries().combine_chunks()
        lang, term = langs.indices.to_numpy(), terms.indices.to_numpy()
        own, p, p0 = (np.concatenate([c.to_numpy() for c in got[k]]) for k in ("own", "p", "p0"))
        for k, name in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(lang == k)
            mine = mine[np.lexsort((own[mine], term[mine]))]
            t, g, x, x0 = term[mine], own[mine], p[mine], p0[mine]
            # The term-major index: where the postings of each posting's term begin and how many they are.
            starts = np.flatnonzero(changes(t))
            n = np.diff(np.append(starts, len(t)))
            of = np.cumsum(changes(t)) - 1
            order = np.argsort(g, kind="stable")
            edge = np.append(np.flatnonzero(changes(g[order])), len(g))
            peers = int(g.max()) + 1
            out: list[tuple] = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                rows = order[lo:hi]
                sums = np.zeros(peers, np.int64)
                met = np.zeros(peers, bool)
                # A row of very many postings is scattered piece by piece.
                cuts = np.searchsorted(np.cumsum(n[of[rows]]), np.arange(0, n[of[rows]].sum(), 4 * INDEX_ROWS)).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(rows)]):
                    some = rows[i:j]
                    many = n[of[some]]
                    at = np.arange(many.sum()) + np.repeat(starts[of[some]] - (np.cumsum(many) - many), many)
                    mp, m0 = np.repeat(x[some], many), np.repeat(x0[some], many)
                    add = _f(mp, x[at]) - _f(mp, x0[at]) - _f(m0, x[at]) + _f(m0, x0[at])
                    np.add.at(sums, g[at], add)
                    met[g[at]] = True
                own_id = int(g[order[lo]])
                met[own_id] = False
                peer = np.flatnonzero(met)
                out.append((np.full(len(peer), own_id), peer, sums[peer]))
            a, b, v = (np.concatenate([o[i] for o in out]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(v)], names=["lang", "own", "peer", "value"])
        give_back()

    return postings.repartitionById(parts, F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int")).mapInArrow(run, "lang string, own long, peer long, value long")


def _apart(rows: DataFrame) -> DataFrame:
    """(lang, own, peer, value): what two groups have from terms that one of them lacks.

    ``rows`` has a group each: lang, own, p0, v (kept terms), counts (p and the
    number of its terms with it), peers (number and p0 of all groups).
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                peer, q0 = (np.array([x[k] for x in r["peers"]], np.int64) for k in ("own", "p0"))
                p, m = (np.array([x[k] for x in r["counts"]], np.int64) for k in ("p", "m"))
                p0 = np.int64(r["p0"])
                out, into = np.zeros(len(peer), np.int64), np.zeros(len(peer), np.int64)
                tile = max(1, 1_000_000 // len(peer))
                for i in range(0, len(p), tile):
                    a, w = p[i : i + tile, None], m[i : i + tile, None]
                    out += (w * _f(a, q0[None, :])).sum(axis=0)
                    into += (w * _f(q0[None, :], a)).sum(axis=0)
                out += (r["v"] - m.sum()) * _f(p0, q0)
                into -= m.sum() * _f(q0, p0)
                far = peer != r["own"]
                n = int(far.sum())
                own = np.full(n, r["own"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * (2 * n), pa.string()), pa.array(np.r_[own, peer[far]]), pa.array(np.r_[peer[far], own]), pa.array(np.r_[out[far], into[far]])], names=["lang", "own", "peer", "value"])

    return rows.mapInArrow(run, "lang string, own long, peer long, value long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased;
    a language keeps those in at least ``least_docs`` of its documents. A
    group's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), N its
    occurrences of kept terms and V the number of kept terms. With
    f(p, q) = floor((p - q)^2 / q):

    - part ``pair``: each other source of the language, with the sum of
      f(p, its p) over all kept terms, all ranks;
    - part ``term``: each kept term that the group has and that has a greater
      share there than in the language, with f, the first ``top`` ranks.

    Ranks go by value, descending, then item. Null texts, languages and sources
    count as empty; a group without terms still has its pairs, with value 0
    where the language keeps no term. Rows that repeat are further documents;
    other columns do not matter. An empty table gives an empty result.

    Memory of a task: the postings it indexes and one accumulator as long as
    the language has sources. The result itself has a row for each two sources.
    """
    counts = shared.written(term_counts(docs, text_col, lang_col, source_col), "terms")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    rows = shared.written(terms.select("lang", "source", "term", "n").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]), "kept")
    of_lang = rows.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("V"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    groups = groups.select("lang", "source", zero("total"), zero("lang_total"), zero("V"), (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("own"))
    p0 = F.when(F.col("V") > 0, _share("0", "total")).otherwise(F.lit(1).cast("bigint"))
    groups = shared.written(groups.withColumn("p0", p0), "groups")

    # Written before the windows, so that groups with very many terms are split in the join.
    shares = rows.join(groups, ["lang", "source"]).select("lang", "source", "own", "term", "p0", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    shares = shared.written(shares, "shares")

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    n = shares.count()
    both = _both(shares.select("lang", "term", "own", "p", "p0"), max(1, -(-n // index_rows)))
    held = shares.groupBy("lang", "own", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "own").agg(F.collect_list(F.struct("p", "m")).alias("counts"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("own", "p0")).alias("peers"))
    none = F.expr("cast(array() as array<struct<p:bigint,m:bigint>>)")
    ready = groups.where("V > 0").join(peers, "lang").join(held, ["lang", "own"], "left").select("lang", "own", "p0", F.col("V").alias("v"), F.coalesce("counts", none).alias("counts"), "peers")
    empty = groups.where("V = 0").select("lang", "own").join(groups.select("lang", F.col("own").alias("peer")), "lang").where("own <> peer").select("lang", "own", "peer", F.lit(0).cast("bigint").alias("value"))
    sums = both.unionByName(_apart(ready)).unionByName(empty).groupBy("lang", "own", "peer").agg(F.sum("value").alias("value"))
    name = groups.select("lang", "own", "source")
    pairs = sums.join(name, ["lang", "own"]).join(name.select("lang", F.col("own").alias("peer"), F.col("source").alias("item")), ["lang", "peer"]).select("lang", "source", "item", "value")
    ranked = pairs.withColumn("rank", F.row_number().over(by))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(ranked, "pair").unionByName(part(first, "term"))
