"""Vectorised text handling shared by the operators: code points, word boundaries and hashes in numpy, with no per-word Python.

A batch of documents is one array of code points plus document bounds.  Words are maximal runs of letters
and numbers (Unicode L and N), lower-cased one code point at a time.  A word's or n-gram's identity is a
64-bit hash: a polynomial in the code points, from prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
SLICE_BYTES = 3 << 20
#: Where many numbers come from a byte of text: a task's arrays then take some 15 to 60 MB instead of 90 to 290.
SMALL_SLICE = 1 << 19


#: Scripts that put no spaces between words: each character counts as a word of its own where units() is used.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a letter or number, lower-case code point, unit class: 0 space or control, 1 word, 2 other, 3 a unit by itself) for every code point."""
    word = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    unit = np.full(0x110000, 2, dtype=np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        kind = unicodedata.category(ch)[0]
        if kind in "LN":
            word[cp] = True
        if kind in "LNM":
            unit[cp] = 1
        elif kind in "ZC":
            unit[cp] = 0
        low = ch.lower()
        if low != ch and len(low) == 1:
            lower[cp] = ord(low)
    for a, b in UNSPACED:
        unit[a : b + 1][unit[a : b + 1] == 1] = 3
    return word, lower, unit


class _Powers:
    pow = np.ones(1, dtype=U64)
    inv = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.pow) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("pow", _P), ("inv", _PINV)):
                a = np.full(size, base, dtype=U64)
                a[0] = 1
                setattr(_Powers, name, np.multiply.accumulate(a))
    return _Powers.pow[:n], _Powers.inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes of text each, so that memory doesn't follow the batch."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds); null is the empty text."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = col.buffers()[2] if n else None
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts as uint32, bounds by document); null is the empty text, bytes that are no UTF-8 become U+FFFD."""
    data, off = utf8(col)
    raw = data.tobytes()
    try:
        cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeDecodeError:
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32), bounds
    if len(cps) == len(data):
        return cps, off
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return cps, heads[off].astype(np.int64)


def runs(flag: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the maximal runs of flag, cut at document bounds."""
    n = len(flag)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    inner = bounds[1:-1]
    before[inner[inner < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    after[inner[inner > 0] - 1] = False
    start = np.flatnonzero(flag & ~before)
    end = np.flatnonzero(flag & ~after) + 1
    return start, end, np.searchsorted(bounds[1:], start, side="right")


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the values; spans() turns them into hashes of any span."""
    pw, _ = powers(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum((values.astype(U64) + U64(1)) * pw[: len(values)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] ^ (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, document) of each word, in order."""
    word, lower, _ = tables()
    start, end, doc = runs(word[cps], bounds)
    return spans(prefix(lower[cps]), start, end), start, end, doc


def units(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like words(), but symbols count too: (hash, start, end, document) of each run of one unit class, spaces left out; scripts without spaces give a unit a character."""
    _, lower, unit = tables()
    n = len(cps)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z
    kind = unit[cps]
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    inner = bounds[1:-1]
    first[inner[inner < n]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return spans(prefix(lower[cps]), start, end), start, end, np.searchsorted(bounds[1:], start, side="right")


def word_hash(text: str) -> int:
    """The hash that words() gives for a text that is one word."""
    cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return int(spans(prefix(tables()[1][cps]), np.array([0]), np.array([len(cps)]))[0])


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of n words; a document of fewer words has one run of all of them."""
    if not len(h):
        return h, doc
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, len(h)))
    pre = prefix(h)
    at = np.arange(len(h))
    last = np.repeat(first + size, size)
    full = at + n <= last
    short = np.zeros(len(h), bool)
    short[first[size < n]] = True
    keep = np.flatnonzero(full | short)
    return spans(pre, keep, np.minimum(keep + n, last[keep])), doc[keep]


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted by both; doc comes in order."""
    if not len(h):
        return doc, h
    x = h.copy()
    cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
        x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
    return doc[keep], x[keep]


def lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted keys, or -1.  A small bitmap turns most absent hashes away before the search."""
    out = np.full(len(h), -1, dtype=np.int64)
    if not len(keys) or not len(h):
        return out
    seen = np.zeros(1 << 16, bool) if len(keys) < 20_000 else np.zeros(1 << 22, bool)
    shift = U64(48 if len(seen) == 1 << 16 else 42)
    seen[keys >> shift] = True
    maybe = np.flatnonzero(seen[h >> shift])
    x = h[maybe]
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    hit = keys[at] == x
    out[maybe[hit]] = at[hit]
    return out


class Slots:
    """A growing hash table from 64-bit hashes to the order in which they came (open addressing, all keys of a call in step)."""

    def __init__(self, bits: int = 16):
        self.size, self.bits = 0, bits
        self.keys, self.values = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        if (self.size + len(h)) * 2 > len(self.keys):
            used = self.values >= 0
            order = np.argsort(self.values[used])
            old = self.keys[used][order]
            self.__init__(max(self.bits, int((self.size + len(h)) * 3).bit_length()))
            h = np.concatenate([old, h])
        number = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            spot = at[left]
            free = self.values[spot] < 0
            self.values[spot[free]] = number[left[free]]  # where several want one place, the last stays
            won = self.values[spot] == number[left]
            self.keys[spot[won]] = h[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        out = self.values[at].astype(np.int64)
        left = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            spot = at[left]
            value = self.values[spot]
            out[left] = value
            left = left[(value >= 0) & (self.keys[spot] != h[left])]
        return out


def strings(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    size = end - start
    total = int(size.sum())
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    c = cps[at]
    width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    upto = np.concatenate([[0], np.cumsum(width)])
    off = upto[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
    data = c.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])
