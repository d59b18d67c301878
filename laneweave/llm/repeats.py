"""Repeated runs of units (words or bytes) across a corpus of any size.

The common ground of substring dedup (words) and suffix-array dedup (bytes).
A window is ``window`` consecutive units of one document; a window is marked
when an equal one starts earlier, and the result is the union of marked
windows.

1. *Parse.* Every document is cut into pieces where a rolling hash triggers. A
   piece goes on for ``window - 1`` units after its last start, so every window
   lies in one piece, and equal passages have equal pieces.
2. *Dictionary.* Pieces meet by hash and are compared byte by byte. All windows
   of a piece that stands earlier are marked at once; the distinct pieces stay,
   each with the places where it starts first.
3. *Triggers.* A window's trigger is the smallest hash of its short runs, so
   equal windows have equal triggers. The dictionary's blocks ask which of
   their triggers stand elsewhere too; the others cannot hold a repeat.
4. *Blocks.* The runs of windows with such a trigger bring their bytes along
   and are compared, block by block, by ``compare``.
5. Marked spans go back to their documents.

Hashes only say what may be equal; bytes decide. Each task sends one packed row
per destination and drops what it can settle itself, so a passage that stands
in a third of all documents costs one entry per task. Triggers that are too
frequent with ever new surroundings are spread: their windows travel alone,
each to the block of its own hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import BYTE_CODES, SLICE_BYTES, SPACED, U64, changes, give_back, gram_chosen, phrases, prefix_sums, run_hash, slices, text_bytes, word_hashes, word_spans, xxhash64_long

SPANS, PIECES, DOCS = 0, 1, 9
#: Bytes that are compared at once.
BLOCK_BYTES = 1 << 20
#: Slices that a task resolves together before it sends anything.
SLICES_TOGETHER = 8
#: Window starts of a piece at most.
LONGEST = 4096
#: Repeated pieces that a task remembers.
REMEMBER = 20_000


@dataclass(frozen=True)
class Plan:
    window: int
    #: Units of the runs whose hashes are triggers.
    gram: int
    words: bool
    #: Does an earlier start in the same document count?
    within: bool
    parts: int
    #: Window starts of a piece on average.
    piece: int
    #: Runs of windows with one trigger beyond which it counts as frequent.
    hot: int = 20_000
    #: Units of a long text that are hashed at once.
    piece_units: int = 1 << 20


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions at, at + 1, ... at + size - 1 of every row, one row after the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] is data[b : b + size], for rows of one byte and more."""
    out = np.zeros(len(a), bool)
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), BLOCK_BYTES)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(a)]):
        if hi > lo:
            n = size[lo:hi]
            differ = data[spread(a[lo:hi], n)] != data[spread(b[lo:hi], n)]
            out[lo:hi] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


class Pieces:
    """Distinct pieces of text (key, bytes, number of window starts) and the places where they start."""

    CONTENT = ("<u8", "<u4", "<u2", "u1")  # key, size, count, bytes
    PLACES = ("<u4", "<i8", "<u8", "<u4")  # piece, doc, tag, start

    def __init__(self, key, size, count, data, of, doc, tag, start):
        self.key, self.size, self.count, self.data = key, size.astype(np.int64), count.astype(np.int64), data
        self.of, self.doc, self.tag, self.start = of.astype(np.int64), doc, tag, start.astype(np.int64)
        self.at = np.cumsum(self.size) - self.size

    @classmethod
    def joined(cls, payloads) -> "Pieces | None":
        got = [shared.thaw(p, *cls.CONTENT, *cls.PLACES) for p in payloads]
        if not got:
            return None
        before = np.cumsum([0] + [len(g[0]) for g in got])
        for g, n in zip(got, before):
            g[4] = g[4] + np.int64(n)
        return cls(*[np.concatenate(c) for c in zip(*got)])

    def settled(self, plan: Plan, hashes: np.ndarray) -> tuple["Pieces", list[np.ndarray]]:
        """Pieces without those that stand earlier, and the spans of these.

        ``hashes`` has one for each piece; pieces of one hash are compared.
        """
        h, at, size = hashes[self.of], self.at[self.of], self.size[self.of]
        leader = np.arange(len(h))
        order = np.argsort(h)
        pair = h[order][1:] == h[order][:-1]
        some = order[np.append(False, pair) | np.append(pair, False)] if len(h) else order
        order = some[np.lexsort((self.start[some], self.doc[some], size[some], h[some]))]
        while len(order):  # what differs from the first of its hash is compared with the next that does
            new = changes(h[order], size[order])
            leader[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            other = order[leader[order] != order]
            order = other[~equal_bytes(self.data, at[other], at[leader[other]], size[other])]
        late = self.doc > self.doc[leader]
        if plan.within:
            late |= (self.doc == self.doc[leader]) & (self.start > self.start[leader])
        spans = self.spans(plan, np.flatnonzero(late))
        kept = np.flatnonzero(~late)
        piece = self.of[leader[kept]]
        # A repeated row brings the same places again.
        some = np.flatnonzero(np.bincount(piece)[piece] > 1) if len(piece) else piece
        rows = kept[some]
        order = np.lexsort((self.start[rows], self.tag[rows], self.doc[rows], piece[some]))
        again = some[order[~changes(*[c[order] for c in (piece[some], self.doc[rows], self.tag[rows], self.start[rows])])]]
        kept, piece = np.delete(kept, again), np.delete(piece, again)
        which, of = np.unique(piece, return_inverse=True)
        return self.picked(which, of, kept), spans

    def picked(self, which: np.ndarray, of: np.ndarray, rows: np.ndarray) -> "Pieces":
        data = self.data[spread(self.at[which], self.size[which])]
        return Pieces(self.key[which], self.size[which], self.count[which], data, of, self.doc[rows], self.tag[rows], self.start[rows])

    def spans(self, plan: Plan, rows: np.ndarray) -> list[np.ndarray]:
        start = self.start[rows]
        return [self.doc[rows], self.tag[rows], start, start + self.count[self.of[rows]] + plan.window - 1]

    def by_part(self, part: np.ndarray):
        """(part, payload) for every part; ``part`` has one for each piece."""
        pieces = np.lexsort((self.key, part))  # equal keys side by side, as their bytes are alike
        place = np.empty(len(pieces), np.int64)
        place[pieces] = np.arange(len(pieces))
        rows = np.argsort(place[self.of], kind="stable")
        edges = np.flatnonzero(np.append(changes(part[pieces]), True))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            p = int(part[pieces[lo]])
            own = rows[slice(*np.searchsorted(place[self.of[rows]], [lo, hi]))]
            x = self.picked(pieces[lo:hi], place[self.of[own]] - lo, own)
            yield p, shared.freeze(*[c.astype(t) for c, t in zip((x.key, x.size, x.count, x.data, x.of, x.doc, x.tag, x.start), self.CONTENT + self.PLACES)])

    def slices(self, limit: int = SLICE_BYTES):
        """(first, end) of runs of pieces with about ``limit`` bytes."""
        lo, ends = 0, np.cumsum(self.size)
        while lo < len(self.size):
            hi = max(lo + 1, int(np.searchsorted(ends, self.at[lo] + limit, "right")))
            yield lo, hi
            lo = hi


def _text_units(plan: Plan, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a slice of texts, where each unit begins (and the end), and each row's first unit.

    Words come with one space after each, whatever stood there.
    """
    data, offsets = text_bytes(column)
    if not plan.words:
        return data, np.arange(len(data) + 1), offsets
    s, e, firsts = word_spans(data, offsets, SPACED)
    size = e - s + 1
    edge = np.append(np.cumsum(size) - size, size.sum())
    spaced = np.full(int(size.sum()), 0x20, np.uint8)
    spaced[spread(edge[:-1], size - 1)] = data[spread(s, size - 1)]
    return spaced, edge, firsts


def _edges(plan: Plan, data: np.ndarray) -> np.ndarray:
    """Where each unit of packed pieces begins, and the end."""
    return np.append(0, np.flatnonzero(data == 0x20) + 1) if plan.words else np.arange(len(data) + 1)


def _codes(plan: Plan, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return word_hashes(data, edge[:-1], edge[1:] - 1) if plan.words else BYTE_CODES[data]


_SPAN = ("<i8", "<u8", "<u4", "<u4")  # doc, tag, start, end


def _home(plan: Plan, doc: np.ndarray) -> np.ndarray:
    return (xxhash64_long(doc) % U64(plan.parts)).astype(np.int64)


def _span_rows(plan: Plan, doc, tag, start, end):
    order = np.lexsort((start, doc))
    return [(q, SPANS, p) for q, p in shared.by_part(_home(plan, doc[order]), *[c[order].astype(t) for c, t in zip((doc, tag, start, end), _SPAN)])]


def _cut(plan: Plan, codes: np.ndarray, firsts: np.ndarray):
    """Pieces of a slice: hash, row, first unit in the row, number of window starts."""
    sums = prefix_sums(codes)
    n = len(codes) - plan.window + 1
    lengths = np.diff(firsts)
    ok = lengths >= plan.window
    if n <= 0 or not ok.any():
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z
    begin, stop = firsts[:-1][ok], firsts[1:][ok] - plan.window + 1
    edge = np.zeros(n + 1, np.int8)
    edge[begin] += 1
    edge[stop] -= 1
    new = (np.cumsum(edge[:-1], dtype=np.int8) > 0) & gram_chosen(sums, plan.gram, plan.piece)[:n]
    new[begin] = True
    first = np.flatnonzero(new)
    count = np.minimum(np.append(first[1:], n), stop[np.searchsorted(begin, first, "right") - 1]) - first
    parts = -(-count // LONGEST)
    if parts.max() > 1:
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + within * LONGEST
        count = np.minimum(LONGEST, np.repeat(count, parts) - within * LONGEST)
    row = np.searchsorted(firsts, first, "right") - 1
    return run_hash(sums, first, count + plan.window - 1), row, first - firsts[row], count


def _parse(plan: Plan) -> Callable:
    def flush(held, known):
        pieces = Pieces(*[np.concatenate(c) for c in zip(*held)][:4], np.arange(sum(len(h[0]) for h in held)), *[np.concatenate([h[i] for h in held]) for i in (4, 5, 6)])
        some = np.bincount(np.unique(pieces.key, return_inverse=True)[1])
        left, spans = pieces.settled(plan, pieces.key)
        rows = _span_rows(plan, *spans)
        # What this task has sent already settles later ones.
        seen = []
        for i in np.flatnonzero(np.isin(left.key, np.fromiter(known, U64, len(known)))).tolist() if known else []:
            doc, start, raw = known[int(left.key[i])]
            mine = np.flatnonzero(left.of == i)
            after = (left.doc[mine] > doc) | (plan.within & (left.doc[mine] == doc) & (left.start[mine] > start))
            if raw == left.data[left.at[i] : left.at[i] + left.size[i]].tobytes():
                seen.append(mine[after])
        gone = np.zeros(len(left.of), bool)
        if seen:
            gone[np.concatenate(seen)] = True
            rows += _span_rows(plan, *left.spans(plan, np.flatnonzero(gone)))
        if some.max(initial=0) > 1 and len(known) < REMEMBER:
            often = np.unique(pieces.key)[some > 1]
            for i in np.flatnonzero(np.isin(left.key, often))[: REMEMBER - len(known)].tolist():
                j = int(np.flatnonzero(left.of == i)[0])
                known.setdefault(int(left.key[i]), (int(left.doc[j]), int(left.start[j]), left.data[left.at[i] : left.at[i] + left.size[i]].tobytes()))
        if gone.any():
            kept = np.flatnonzero(~gone)
            which, of = np.unique(left.of[kept], return_inverse=True)
            left = left.picked(which, of, kept)
        rows += [(p, PIECES, b) for p, b in left.by_part(((left.key >> U64(20)) % U64(plan.parts)).astype(np.int64))]
        return shared.packed_batch(rows)

    def run(batches):
        held, known = [], {}
        for batch in slices(batches, "text"):
            data, edge, firsts = _text_units(plan, batch.column("text"))
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy().view(U64)
            jobs = [(0, len(edge) - 1, firsts, 0)]
            if len(firsts) == 2 and len(edge) > plan.piece_units:  # a long text
                reach = plan.window - 1
                jobs = [(u, v, np.array([0, v - u]), u) for u in range(0, len(edge) - 1, plan.piece_units) if (v := min(u + plan.piece_units + reach, len(edge) - 1)) - u > reach]
            for u, v, f, shift in jobs:
                own = data[edge[u] : edge[v]]
                ends = edge[u : v + 1] - edge[u]
                h, row, start, count = _cut(plan, _codes(plan, own, ends), f)
                unit = f[row] + start
                size = ends[unit + count + plan.window - 1] - ends[unit]
                held.append((h, size, count, own[spread(ends[unit], size)], docs[row], tags[row], start + shift))
                if len(held) >= SLICES_TOGETHER:
                    yield flush(held, known)
                    held = []
        if held:
            yield flush(held, known)

    return run


def _table(rows) -> pa.Table:
    return pa.Table.from_batches([shared.packed_batch(rows)])


def _payloads(table: pa.Table, kind: int) -> list[bytes]:
    return [p for k, p in zip(table["kind"].to_pylist(), table["payload"].to_pylist()) if k == kind]


def _runs(plan: Plan, pieces: Pieces):
    """Runs of windows with one trigger, a slice of pieces at a time: trigger, text hash, piece, start, count, bytes' place and size, and whether the trigger stands in it twice."""
    for lo, hi in pieces.slices():
        base = int(pieces.at[lo])
        data = pieces.data[base : base + int(pieces.size[lo:hi].sum())]
        edge = _edges(plan, data)
        firsts = np.searchsorted(edge, np.append(pieces.at[lo:hi] - base, len(data)))
        trigger, text, unit, count, again = phrases(_codes(plan, data, edge), firsts, plan.window, plan.gram, twice=plan.within)
        row = np.searchsorted(firsts, unit, "right") - 1
        place = edge[unit]
        yield trigger, text, row + lo, unit - firsts[row], count, place + base, edge[unit + count + plan.window - 1] - place, again


def _trigger_part(plan: Plan, trigger: np.ndarray) -> np.ndarray:
    return ((trigger >> U64(32)) % U64(plan.parts)).astype(np.int64)


_ASK = ("<i4", "<u4", "u1", "<u2")  # asking block (one), trigger, has it two places, how many (65535: as many or more)


def _ask(plan: Plan) -> Callable:
    """One block of the dictionary: its distinct triggers, to the blocks where triggers meet."""

    def run(table: pa.Table) -> pa.Table:
        pieces = Pieces.joined(_payloads(table, PIECES))
        if pieces is None:
            return _table([])
        pieces, _ = pieces.settled(plan, pieces.key)
        doc = np.zeros(len(pieces.key), np.int64)
        doc[pieces.of] = pieces.doc
        found = [(trigger, doc[piece], again) for trigger, _, piece, *_, again in _runs(plan, pieces)]
        del pieces
        trigger, doc, again = (np.concatenate(c) for c in zip(*found))
        part = _trigger_part(plan, trigger)
        key = (part.astype(U64) << U64(32)) | (trigger & U64(0xFFFFFFFF))
        order = np.argsort(key)
        key, doc, again = key[order], doc[order], again[order]
        first = np.flatnonzero(changes(key))
        number = np.diff(np.append(first, len(key)))
        twice = (number > 1) | np.logical_or.reduceat(again, first) if plan.within else np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        key = key[first]
        out, mine = [], np.array([table["part"][0].as_py()])
        where = (key >> U64(32)).astype(np.int64)
        for q in np.unique(where).tolist():
            k = slice(*np.searchsorted(where, [q, q + 1]))
            out.append((q, PIECES, shared.freeze(*[c.astype(t) for c, t in zip((mine, key[k], twice[k], np.minimum(number[k], 65535)), _ASK)])))
        give_back()
        return _table(out)

    return run


_ANSWER = ("<i4", "<u4", "u1")  # answering block (one), trigger, is it frequent


def _answer(plan: Plan) -> Callable:
    """One block of triggers: tell every asking block which of its triggers stand at two places or more."""

    def run(table: pa.Table) -> pa.Table:
        got = [shared.thaw(p, *_ASK) for p in _payloads(table, PIECES)]
        mine = np.array([table["part"][0].as_py()])
        asker = np.repeat([int(g[0][0]) for g in got], [len(g[1]) for g in got])
        trigger, twice, number = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
        order = np.argsort(trigger, kind="stable")
        first = np.flatnonzero(changes(trigger[order]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(changes(trigger[order])) - 1
        common = (np.diff(np.append(first, len(order))) > 1) | (np.bincount(group, weights=twice) > 0)
        frequent = np.bincount(group, weights=number) > plan.hot
        out = []
        for p in np.unique(asker).tolist():
            k = np.flatnonzero((asker == p) & common[group])
            out.append((p, PIECES, shared.freeze(*[c.astype(t) for c, t in zip((mine, trigger[k], frequent[group[k]]), _ANSWER)])))
        return _table(out)

    return run


def _bring(plan: Plan) -> Callable:
    """One block of the dictionary with the answers: the spans of what stands earlier, and the runs that may be repeated."""

    def send(rows, trigger, text, piece, start, count, at, size, pieces, where):
        """Settle runs, or windows, of this block among themselves; the others go to the blocks of their triggers."""
        number = np.bincount(pieces.of, minlength=len(pieces.key))
        first = np.cumsum(number) - number
        by_piece = np.argsort(pieces.of, kind="stable")
        n = number[piece]
        place = by_piece[spread(first[piece], n)]
        run = np.repeat(np.arange(len(piece)), n)
        runs = Pieces(trigger, size, count, pieces.data[spread(at, size)], run, pieces.doc[place], pieces.tag[place], pieces.start[place] + start[run])
        # ``key`` names the run while they settle, so that each keeps its block.
        runs.key = np.arange(len(trigger), dtype=U64)
        left, spans = runs.settled(plan, text)
        rows += _span_rows(plan, *spans)
        own = left.key.astype(np.int64)
        left.key = trigger[own]
        rows += [(q, PIECES, b) for q, b in left.by_part(where[own])]

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [(p, SPANS, b) for p, k, b in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist()) if k == SPANS]
        pieces = Pieces.joined(_payloads(table, PIECES))
        got = [shared.thaw(p, *_ANSWER) for p in _payloads(answers, PIECES)]
        if pieces is None:
            return _table(rows)
        pieces, spans = pieces.settled(plan, pieces.key)
        rows += _span_rows(plan, *spans)
        common = np.concatenate([(U64(g[0][0]) << U64(32)) | g[1].astype(U64) for g in got]) if got else np.zeros(0, U64)
        frequent = np.concatenate([g[2] for g in got]) if got else np.zeros(0, np.uint8)
        order = np.argsort(common)
        common, frequent = common[order], frequent[order].astype(bool)
        kept: list = []
        for found in _runs(plan, pieces):
            part = _trigger_part(plan, found[0])
            key = (part.astype(U64) << U64(32)) | (found[0] & U64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(common, key), max(0, len(common) - 1))
            ask = np.flatnonzero(common[at] == key) if len(common) else np.zeros(0, np.int64)
            kept.append([c[ask] for c in (*found[:7], part)] + [frequent[at[ask]] if len(common) else np.zeros(0, bool)])
        trigger, text, piece, start, count, at, size, part, hot = (np.concatenate(c) for c in zip(*kept))
        plain = ~hot
        send(rows, *[c[plain] for c in (trigger, text, piece, start, count, at, size)], pieces, part[plain])
        for found in _windows(plan, pieces, *[c[hot] for c in (piece, start, count, at, size)]):
            send(rows, *found, pieces, _trigger_part(plan, found[0]))
        give_back()
        return _table(rows)

    return run


def _windows(plan: Plan, pieces: Pieces, piece, start, count, at, size):
    """Single windows of runs, some at a time, with their own hash as trigger."""
    ends = np.cumsum(count)
    for lo_start in range(0, int(ends[-1]) if len(ends) else 0, 1 << 16):
        k = slice(np.searchsorted(ends, lo_start, "right"), np.searchsorted(ends, lo_start + (1 << 16), "right"))
        if k.start == k.stop:
            continue
        data = pieces.data[spread(at[k], size[k])]
        edge = _edges(plan, data)
        sums = prefix_sums(_codes(plan, data, edge))
        first = np.searchsorted(edge, np.cumsum(size[k]) - size[k])
        n = count[k]
        unit = spread(first, n)
        row = np.repeat(np.arange(len(n)), n)
        own = unit - first[row]
        h = run_hash(sums, unit, plan.window)
        place = edge[unit] - edge[first[row]] + at[k][row]
        yield h, h, piece[k][row], start[k][row] + own, np.ones(len(h), np.int64), place, edge[unit + plan.window] - edge[unit]


def _compare_block(plan: Plan, compare: Callable) -> Callable:
    def run(batches):
        held = []
        for batch in batches:
            for part, kind, payload in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload")):
                if kind == SPANS:
                    yield shared.packed_batch([(part, SPANS, payload.as_py())])
                else:
                    held.append(payload.as_py())
        pieces = Pieces.joined(held)
        if pieces is None:
            return
        del held
        bins = -(-len(pieces.data) // BLOCK_BYTES)
        mine = (pieces.key >> U64(7)) % U64(max(1, bins))
        own = mine[pieces.of]
        for i in range(bins):  # equal windows share a trigger, so bins are independent
            rows = np.flatnonzero(own == i)
            if not len(rows):
                continue
            which, of = np.unique(pieces.of[rows], return_inverse=True)
            x = pieces.picked(which, of, rows)
            # Equal runs from different blocks of the dictionary first.
            edge = _edges(plan, x.data)
            text = run_hash(prefix_sums(_codes(plan, x.data, edge)), np.searchsorted(edge, x.at), x.count + plan.window - 1)
            x, spans = x.settled(plan, text)
            yield shared.packed_batch(_span_rows(plan, *spans))
            if not plan.within:  # a run that is alone at its trigger has nothing left to meet
                _, same, number = np.unique(x.key, return_inverse=True, return_counts=True)
                rows = np.flatnonzero((number > 1)[same][x.of])
                which, of = np.unique(x.of[rows], return_inverse=True)
                x = x.picked(which, of, rows)
            if not len(x.of):
                continue
            doc, start = np.zeros(len(x.key), np.int64), np.zeros(len(x.key), np.int64)
            doc[x.of], start[x.of] = x.doc, x.start  # all places of a piece are equally early
            edge = _edges(plan, x.data)
            piece, first, last = compare(plan, x.data, edge, np.searchsorted(edge, x.at), x.count, doc, start)
            # Every place of a piece has its spans.
            n = np.bincount(x.of, minlength=len(x.key))
            by_piece = np.argsort(x.of, kind="stable")
            place = by_piece[spread((np.cumsum(n) - n)[piece], n[piece])]
            hit = np.repeat(np.arange(len(piece)), n[piece])
            yield shared.packed_batch(_span_rows(plan, x.doc[place], x.tag[place], x.start[place] + first[hit], x.start[place] + last[hit] + plan.window))
        give_back()

    return run


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def find_spans(docs: DataFrame, plan: Plan, compare: Callable) -> tuple[DataFrame, DataFrame]:
    """(rows with their home group, packed spans by home group).

    ``docs`` has doc (no null), tag and text. ``compare(plan, bytes, unit
    edges, first units, window starts, docs, starts)`` gets the distinct pieces
    of a block and returns piece, first and last start of every repeated run.
    """
    parts = plan.parts
    part = F.col("part")
    # Used twice; Spark shuffles it once.
    dictionary = docs.select("doc", "tag", "text").mapInArrow(_parse(plan), shared.PACKED).repartitionById(parts, part)
    asked = dictionary.groupBy("part").applyInArrow(_ask(plan), shared.PACKED).repartitionById(parts, part)
    answers = asked.groupBy("part").applyInArrow(_answer(plan), shared.PACKED).repartitionById(parts, part)
    brought = dictionary.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_bring(plan), shared.PACKED)
    spans = shared.written(brought.repartitionById(parts, part).mapInArrow(_compare_block(plan, compare), shared.PACKED), "spans")
    return at_home(docs, parts), spans


def at_home(docs: DataFrame, parts: int) -> DataFrame:
    """Each row's group: Spark's xxhash64 of doc, unsigned, modulo ``parts``."""
    h = F.xxhash64("doc")
    # (h as unsigned) mod parts, in signed arithmetic
    part = F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(parts)) * 2 + F.pmod(h, F.lit(2)), F.lit(parts))
    return docs.withColumn("part", part.cast("int"))


class _Lookup:
    """Spans of documents, by identifier and tag."""

    def __init__(self, doc, tag, start, end):
        self.docs, a = np.unique(doc, return_inverse=True)
        self.tags, b = np.unique(tag, return_inverse=True)
        key = (a.astype(np.int64) << 32) | b
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.end = key[order], start[order], end[order]

    def of(self, doc, tag) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of each document's spans."""
        if not len(self.key):
            z = np.zeros(len(doc), np.int64)
            return z, z
        a = np.minimum(np.searchsorted(self.docs, doc), len(self.docs) - 1)
        b = np.minimum(np.searchsorted(self.tags, tag), len(self.tags) - 1)
        key = np.where((self.docs[a] == doc) & (self.tags[b] == tag), (a << 32) | b, -1)
        return np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")


def apply_spans(docs: DataFrame, spans: DataFrame, parts: int, cut: Callable, schema: str, rest: list[str]) -> DataFrame:
    """Give every document its merged spans and let ``cut`` make the output columns.

    ``cut(text bytes, starts, ends)`` returns a tuple in the order of
    ``schema``; the columns in ``rest`` pass through.
    """
    types = docs.select(*rest).schema
    names = [part.split()[0] for part in schema.split(", ")]
    full = docs.select("part", F.lit(DOCS).alias("kind"), F.lit(None).cast("binary").alias("payload"), "doc", "tag", "text", F.struct(*rest).alias("rest"))
    none = full.schema
    given = spans.select("part", "kind", "payload", *[F.lit(None).cast(none[c].dataType).alias(c) for c in ("doc", "tag", "text", "rest")])
    out = f"rest {types.simpleString()}, {schema}"

    def run(batches):
        held: list[bytes] = []
        look = None
        made = None
        for batch in slices(batches, "text"):
            kinds = batch.column("kind").to_numpy()
            held += [p.as_py() for p, k in zip(batch.column("payload"), kinds) if k == SPANS]
            if (kinds != DOCS).all():
                continue
            if look is None:
                look = _Lookup(*shared.unpack_all(held, *_SPAN))
                held = []
            batch = batch.filter(pa.array(kinds == DOCS))
            lo, hi = look.of(batch.column("doc").to_numpy(), batch.column("tag").to_numpy().view(U64))
            data, offsets = text_bytes(batch.column("text"))
            data = data.tobytes()
            rows = []
            for i in range(batch.num_rows):
                s, e = merged(look.start[lo[i] : hi[i]], look.end[lo[i] : hi[i]]) if hi[i] > lo[i] else (look.start[:0], look.end[:0])
                rows.append(cut(data[offsets[i] : offsets[i + 1]], s, e))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            made = made or [f.type for f in _arrow_fields(schema)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *[pa.array(c, t) for c, t in zip(columns, made)]], names=["rest", *names])

    joined = given.unionByName(full).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(run, out)
    return joined.select(*[F.col(f"rest.`{c}`").alias(c) for c in rest], *names)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def _arrow_fields(schema: str):
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        yield pa.field(name, _ARROW["spans" if kind.startswith("array") else kind])
