"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow slice inside a task: string columns become
byte arrays with offsets, words become spans of bytes with a hash of their own, and
any run of units (bytes or words) gets a 64-bit polynomial hash from prefix
sums, so that no Python loop runs per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Text bytes handled at once in a task; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for one BIGINT column, for routing."""
    p1, p2, p3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
    p4, p5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)

    def turn(v: np.ndarray, n: int) -> np.ndarray:
        return (v << U64(n)) | (v >> U64(64 - n))

    v = x.astype(np.int64).view(U64)
    with np.errstate(over="ignore"):
        h = np.full(len(v), U64(seed) + p5 + U64(8), U64)
        h ^= turn(v * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h ^= h >> U64(33)
        h *= p2
        h ^= h >> U64(29)
        h *= p3
        h ^= h >> U64(32)
    return h


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def need(cls, n: int) -> None:
        if n > len(cls.up):
            n = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                v = np.full(n, base, U64)
                v[0] = 1
                setattr(cls, name, np.multiply.accumulate(v))


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``run_hash`` reads the hash of any run."""
    _Powers.need(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * _Powers.up[: len(codes)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """Hash of codes[start:start+length] for every start (length joins in)."""
    h = (sums[starts + lengths] - sums[starts]) * _Powers.down[starts]
    return mix(h + np.asarray(lengths).astype(U64) * U64(0xA0761D6478BD642F))


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k units, as ``run_hash`` would give."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, U64)
    h = (sums[k:] - sums[:n]) * _Powers.down[:n]
    return mix(h + U64(k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def gram_chosen(sums: np.ndarray, k: int, one_in: int) -> np.ndarray:
    """True at about one in ``one_in`` of all runs of k units, the same ones wherever they stand."""
    n = max(0, len(sums) - k)
    h = (sums[k:] - sums[:n]) * _Powers.down[:n]
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    return h < U64((1 << 64) // one_in)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Cut record batches so that a column's bytes stay within ``limit``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def byte_class(separators) -> np.ndarray:
    """Table that is true for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words that white space separates: 0x20 and 0x09-0x0D.
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
#: Words of ASCII letters and digits and of every non-ASCII byte.
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word index."""
    inside = is_word[data]
    begins = inside.copy()
    ends = inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = inside[first]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = inside[last]
    s = np.flatnonzero(begins)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


#: Words hashed at once, and bytes beyond which a word goes to the library's hash.
_WORDS_TOGETHER, _LONG_WORD = 1 << 17, 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word's bytes.

    Eight bytes at a time go through the finaliser, so that every byte and its
    place act on all bits; words of one length up to eight bytes never collide.
    Long words are left to XXH3. (Sums of powers would not do: modulo 2^64
    there are pairs of words that collide whatever the base is.)
    """
    out = np.empty(len(starts), U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    for i in range(0, len(starts), _WORDS_TOGETHER):
        s = starts[i : i + _WORDS_TOGETHER]
        size = ends[i : i + _WORDS_TOGETHER] - s
        h = mix(size.astype(U64) * U64(0xA0761D6478BD642F))
        plain = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
        at, left = s[plain], size[plain]
        while len(plain):
            unused = np.maximum(8 - left, 0).astype(U64) * U64(8)
            h[plain] = mix(h[plain] ^ ((lanes[at] << unused) >> unused))
            on = left > 8
            plain, at, left = plain[on], at[on] + 8, left[on] - 8
        for j in np.flatnonzero(size > _LONG_WORD).tolist():
            h[j] = xxhash.xxh3_64_intdigest(data[s[j] : s[j] + size[j]].tobytes(), 42)
        out[i : i + len(h)] = h
    return out


def _trigger_pairs(grams: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of triggers, and how many before each are equal to the one after them."""
    # A gram is a trigger if it is the smallest of a window that covers it.
    wide = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)])
    most = ~sliding_min(~wide, width)
    at = np.flatnonzero(most == grams)
    same = grams[at[:-1]] == grams[at[1:]]
    return at, np.concatenate([np.zeros(1, np.int64), np.cumsum(same)])


def phrases(codes: np.ndarray, offsets: np.ndarray, window: int, gram: int, longest: int = 64, twice: bool = True):
    """Cut every row's window starts into phrases at rolling-hash triggers.

    A window's trigger is the smallest hash of its ``gram``-unit runs, so equal
    windows have equal triggers wherever they occur. A phrase is a maximal run
    of starts with one trigger (cut at ``longest``); its text is those windows
    together. Returns trigger, text hash, first start, number of starts, and
    whether the trigger stands there more than once, so that windows of the
    phrase may equal each other (not looked for without ``twice``).
    """
    sums = prefix_sums(codes)
    n = len(codes) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z.astype(U64), z, z, z.astype(bool)
    grams = gram_hashes(sums, gram)
    low = sliding_min(grams, window - gram + 1)
    edge = np.zeros(n + 1, np.int64)
    lengths = np.diff(offsets)
    ok = lengths >= window
    np.add.at(edge, offsets[:-1][ok], 1)
    np.add.at(edge, offsets[1:][ok] - window + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    new[offsets[:-1][ok]] = True
    first = np.flatnonzero(new)
    after = np.append(first[1:], n)
    stop = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
    count = np.minimum(after, stop[np.searchsorted(stop, first, "right")]) - first
    parts = -(-count // longest)
    if len(parts) and parts.max() > 1:
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + within * longest
        count = np.minimum(longest, np.repeat(count, parts) - within * longest)
    if not twice:
        return low[first], run_hash(sums, first, count + window - 1), first, count, np.zeros(len(first), bool)
    places, pairs = _trigger_pairs(grams, low, window - gram + 1)
    a, b = np.searchsorted(places, first), np.searchsorted(places, first + count + window - gram)
    again = pairs[np.maximum(b - 1, 0)] > pairs[np.minimum(a, len(pairs) - 1)]
    return low[first], run_hash(sums, first, count + window - 1), first, count, again & (b - a > 1)
