"""Operator 4, token-id output: Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector (its top bits) and 60 bits of payload: selector s packs COUNT[s] ids of WIDTH[s] bits,
the first id lowest.  Selector 1 is a run of 120 zeros; selector 0 is the escape for an id of over 60 bits, which follows
as a word of its own.  A document's ids are coded in blocks of BLOCK ids; each block starts at a word of its own, and the
document's row has the word at which each block starts, so blocks are decoded apart from each other.  Within a block each
word takes as many ids as fit (a block's last word may be filled up with zeros).

Coding looks at all blocks of a batch at once: sliding maxima of the ids' widths give the selector of a word that would start at any
id, and the words that do are followed from block to block in step.  Decoding goes through all words of one selector at once (a word
after an escape is an id over 60 bits, so it never looks like an escape itself).  The query codes the byte-level BPE ids of the
documents; the payload is little-endian words.  No row is shuffled.

Defined results: a null text has a null payload, null offsets and null n_tokens; the empty text has an empty payload and
no block; very long texts have as many blocks as they need.  A null id stays null; repeated rows each get a row; an empty table gives an
empty result; further columns are not read.  Ids are 0 to 2**64-1: unpack() gives longs and raises an error for ids from 2**63 on,
unless it is asked for wide ones (decimals).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .bpe import VOCABULARY, codec, vocabulary_of
from .frames import text_rows

COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 128
SCHEMA = "doc_id long, n_tokens long, n_words long, payload binary, block_offsets array<int>"
_U = np.uint64


def blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first id, ids, document) of each block, for documents of so many ids."""
    many = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = (np.cumsum(counts) - counts)[doc] + nth * BLOCK
    return start, np.minimum(counts[doc] - nth * BLOCK, BLOCK), doc


_LIMITS = np.array([(1 << int(w)) - 1 for w in WIDTH[1:]], _U)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=_U), side="left").astype(np.uint8) + 1


def widths(ids: np.ndarray) -> np.ndarray:
    """The first selector wide enough for each id; 16: escape."""
    large = np.flatnonzero(ids >> _U(16))
    out = _SMALL[(ids & _U(0xFFFF)).astype(np.int64)]
    out[large] = np.searchsorted(_LIMITS, ids[large], side="left").astype(np.uint8) + 1
    return out


def selectors(need: np.ndarray) -> np.ndarray:
    """[block, place]: the selector of a word that starts there, from need [block, place], which has COUNT[1] places of 0 at the end."""
    size = need.shape[1] - int(COUNT[1])
    most, width = {1: need}, 1
    while width * 2 <= COUNT[1]:  # greatest need in the next 2, 4, 8 ... places
        m = most[width]
        most[width * 2] = m.copy()
        np.maximum(m[:, :-width], m[:, width:], out=most[width * 2][:, :-width])
        width *= 2
    choice = np.zeros((len(need), size), np.uint8)
    for s in range(15, 0, -1):
        n = int(COUNT[s])
        half = 1 << (n.bit_length() - 1)
        choice[np.maximum(most[half][:, :size], most[half][:, n - half : n - half + size]) <= s] = s
    return choice


def encode(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all blocks in order, words of each block); start and size: the blocks, of BLOCK ids at most."""
    ids = ids.astype(_U, copy=False)
    blocks_, room = len(start), BLOCK + int(COUNT[1])
    words = np.zeros(blocks_, np.int64)
    if not len(ids) or not blocks_:
        return np.zeros(0, _U), words
    row = np.repeat(np.arange(blocks_), size)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size) + nth
    need = np.zeros((blocks_, room), np.uint8)
    need[row, nth] = widths(ids[at])
    grid = np.zeros((blocks_, room), _U)
    grid[row, nth] = ids[at]
    choice = selectors(need)
    live = np.flatnonzero(size > 0)
    p, e = np.zeros(len(live), np.int64), size[live].astype(np.int64)
    where, place, picked, block = [], [], [], []
    while len(live):
        s = choice[live, p]
        where.append(words[live])
        place.append(p)
        picked.append(s)
        block.append(live)
        words[live] += 1 + (s == 0)
        p = p + COUNT[s]
        more = p < e
        live, p, e = live[more], p[more], e[more]
    base = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), _U)
    block, place, picked = np.concatenate(block), np.concatenate(place), np.concatenate(picked)
    to = base[block] + np.concatenate(where)
    order = np.argsort(picked, kind="stable")
    cuts = np.searchsorted(picked[order], np.arange(17))
    flat = grid.reshape(-1)
    for s in range(16):
        sel = order[cuts[s] : cuts[s + 1]]
        if not len(sel):
            continue
        first = block[sel] * room + place[sel]
        if s == 0:
            out[to[sel] + 1] = flat[first]
            continue
        value = np.full(len(sel), s << 60, _U)
        if WIDTH[s]:
            for j in range(COUNT[s]):
                value |= flat[first + j] << _U(j * int(WIDTH[s]))
        out[to[sel]] = value
    return out, words


def decode(words: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of all blocks, from the word at which each starts and its ids."""
    words = words.astype(_U, copy=False)
    n = len(words)
    selector = (words >> _U(60)).astype(np.int64)
    head = np.ones(n, bool)
    head[1:] = selector[:-1] != 0  # what follows an escape is an id; its top bits aren't all 0, so no run of escapes is misread
    block = np.searchsorted(offsets, np.arange(n), side="right") - 1
    count = np.where(head, COUNT[selector], 0)
    upto = np.cumsum(count) - count
    inside = upto - upto[offsets[block]] if n else upto
    base = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), _U)
    for s in range(16):
        sel = np.flatnonzero(head & (selector == s))
        if not len(sel):
            continue
        if s == 0:
            out[base[block[sel]] + inside[sel]] = words[sel + 1]
            continue
        mask = _U((1 << int(WIDTH[s])) - 1)
        for j in range(COUNT[s]):
            k = inside[sel] + j
            good = k < size[block[sel]]
            out[base[block[sel[good]]] + k[good]] = words[sel[good]] >> _U(j * int(WIDTH[s])) & mask
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_words, payload and block_offsets for every row of docs (doc_id, text)."""

    shared = vocabulary_of(docs, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part in tk.slices(batch, 1):
                ids, cuts = c.encode(part.column(1))
                counts = np.diff(cuts)
                start, size, doc = blocks(counts)
                words, per = encode(ids, start, size)
                n_words = np.bincount(doc, weights=per, minlength=len(counts)).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(n_words)])
                offsets = (np.cumsum(per) - per) - upto[doc]
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                many = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))]).astype(np.int32)
                payload = pa.Array.from_buffers(pa.binary(), len(counts), [pa.array(~null).buffers()[1], pa.py_buffer((upto * 8).astype(np.int32).tobytes()), pa.py_buffer(words.astype("<u8").tobytes())])
                place = pa.array(many, mask=np.append(null, False)) if null.any() else pa.array(many)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64(), mask=null), pa.array(n_words, pa.int64(), mask=null), payload, pa.ListArray.from_arrays(place, pa.array(offsets, pa.int32()))],
                    ["doc_id", "n_tokens", "n_words", "payload", "block_offsets"],
                )

    return text_rows(docs).mapInArrow(work, SCHEMA)


def unpack(rows: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, ids) of packed rows, all of a batch decoded at once; wide: ids as decimals, which can be over 2**63-1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch.column(2)
            null = payload.is_null().to_numpy(zero_copy_only=False)
            n = np.where(null, 0, batch.column(1).fill_null(0).to_numpy())
            raw = payload.fill_null(b"") if null.any() else payload
            off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset :][: len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
            words = np.frombuffer(bytes(memoryview(raw.buffers()[2])[off[0] : off[-1]]), "<u8") if off[-1] > off[0] else np.zeros(0, _U)
            _, size, doc = blocks(n)
            offsets = batch.column(3).flatten().to_numpy().astype(np.int64) + (off[doc] - off[0]) // 8
            ids = decode(words, offsets, size)
            if wide:
                values = pa.array(ids).cast(pa.decimal128(20, 0))
            elif len(ids) and int(ids.max()) >> 63:
                raise ValueError("an id of 2**63 or more needs unpack(wide=True)")
            else:
                values = pa.array(ids.astype(np.int64))
            place = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(place, mask=np.append(null, False)) if null.any() else pa.array(place), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return rows.select("doc_id", "n_tokens", "payload", "block_offsets").mapInArrow(work, f"doc_id long, ids array<{'decimal(20,0)' if wide else 'long'}>")
