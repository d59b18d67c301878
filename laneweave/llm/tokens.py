"""Token ids of whole texts, by the tokenizers library, in tasks."""

from __future__ import annotations

import os

import numpy as np

from .arrays import byte_class, text_bytes, word_hashes, word_spans

_BREAKS = byte_class([0x20, 0x0A])
_ASCII_SPACE = ~byte_class([*range(0x09, 0x0E), *range(0x1C, 0x21)])
#: First bytes of the UTF-8 forms that hold white space beyond ASCII.
_SPACE_LEADS = ~byte_class([0xC2, 0xE1, 0xE2, 0xE3])


def _kept_space_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut before a single space, and around a single line feed, between visible characters.

    A pre-tokenizer that keeps white space never joins across these places.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = _ASCII_SPACE[data]
    lead = _SPACE_LEADS[data]
    blank_before = np.ones(n, bool)  # the character before may be white space, or there is none
    blank_before[1:] = space[:-1]
    tail = data >= 0x80
    blank_before[2:] |= lead[:-2] & tail[1:-1]
    blank_before[3:] |= lead[:-3] & tail[1:-2] & tail[2:-1]
    blank_after = np.ones(n, bool)
    blank_after[:-1] = space[1:] | lead[1:]
    filled = offsets[:-1] < offsets[1:]
    blank_before[offsets[:-1][filled]] = True
    blank_after[offsets[1:][filled] - 1] = True
    alone = ~blank_before & ~blank_after
    cut = ((data == 0x20) | (data == 0x0A)) & alone
    cut[1:] |= (data[:-1] == 0x0A) & alone[:-1]
    cut[offsets[:-1][filled]] = True
    s = np.flatnonzero(cut)
    return s, np.append(s[1:], n), np.searchsorted(s, offsets)


class Encoder:
    """Ids of texts, encoding each distinct unit of text once.

    Units are pieces of text across whose ends the file's pre-tokenizer never
    joins, so a text's ids are those of its units in a row. Units are told
    apart by a 64-bit hash with their length; ``remember`` bounds how many a
    worker keeps.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces = self.tokenizer.normalizer is None
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if self.keeps_spaces:  # byte-level: a token's text has one character for each byte
            vocab = self.tokenizer.get_vocab()
            self.id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.id_bytes[i] = len(token)
        else:
            (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.remember = remember
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.type)

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each unit's place and number of ids of units, many at a time.

        Plain units go to the library as one text and are told apart again: by
        the bytes that each id stands for, or by a separator that none holds.
        """
        encode = self.tokenizer.encode_batch_fast
        if self.keeps_spaces:
            plain = [u[:1] == " " and u.split() == [u[1:]] for u in units]
        else:
            plain = ["|" not in u for u in units]
        some = [u for u, p in zip(units, plain) if p]
        rest = [e.ids for e in encode([u for u, p in zip(units, plain) if not p], add_special_tokens=False)]
        size, flat = np.zeros(len(units), np.int64), []
        plain = np.array(plain, bool)
        size[~plain] = [len(r) for r in rest]
        if some:
            ids = np.array(encode([("" if self.keeps_spaces else " | ").join(some)], add_special_tokens=False)[0].ids, self.type)
            if self.keeps_spaces:
                ends = np.cumsum(np.fromiter((len(u.encode()) for u in some), np.int64, len(some)))
                reached = np.searchsorted(np.cumsum(self.id_bytes[ids]), ends, "left") + 1
            else:
                bars = ids == self.bar
                reached = np.append(np.flatnonzero(bars) - np.arange(bars.sum()), len(ids) - bars.sum())
                ids = ids[~bars]
            size[plain] = np.diff(reached, prepend=0)
            flat.append(ids)
        at = np.zeros(len(units), np.int64)
        at[plain] = np.cumsum(size[plain]) - size[plain]
        at[~plain] = np.cumsum(size[~plain]) - size[~plain] + size[plain].sum()
        flat.append(np.array([i for r in rest for i in r], self.type))
        return np.concatenate(flat), at, size

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        flat, at, size = self._ids(units)
        to = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, to, hashes)
        self.at = np.insert(self.at, to, len(self.pool) + at)
        self.size = np.insert(self.size, to, size)
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column's rows, one after the other, and each row's offset; null is empty."""
        data, offsets = text_bytes(column)
        if self.keeps_spaces:
            s, e, rows = _kept_space_units(data, offsets)
        else:  # this file drops all white space
            s, e, rows = word_spans(data, offsets, _BREAKS)
        h = word_hashes(data, s, e)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > self.remember:
            self._forget()
        near = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = near < len(self.hashes)
        new[inside] = self.hashes[near[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            f = first[new]
            self._learn(distinct[new], [raw[a:b].decode("utf-8") for a, b in zip(s[f].tolist(), e[f].tolist())])
            near = np.searchsorted(self.hashes, distinct)
        size, at = self.size[near][back], self.at[near][back]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        take = np.repeat(at - ends[:-1], size) + np.arange(ends[-1])
        return self.pool[take], ends[rows]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
