"""Operator 6, byte-level BPE encoding and decoding, without regex.

Pre-tokenisation works on a batch's code points: a table gives each its class (letter, number, blank, other white space,
other), an apostrophe that a contraction's letters follow gets a class of its own, and a finite automaton over the classes
carries the context from left to right.  Its transition functions compose associatively, so the automaton is run as a scan:
blocks of code points advance in step from every possible state, the blocks' functions are chained, and each block is then
run again from its true state.  State and class at a position say whether a piece starts there.  The pieces are those of
the public 50k pattern ('s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|white space before white space|white space).

Pieces are looked up by hash in a bank of those merged before.  New ones are merged from their bytes, all in step: in each round the pair
of the lowest rank of each piece (of equals the first) becomes one token, until no pair of it is in the vocabulary; long pieces
are merged by a heap.  The pairs are read off the vocabulary: two of its tokens are one if their bytes together are a token.  The
bank has two halves; when the newer is full the older is forgotten, and what is used moves to the newer, so memory doesn't follow the
input.  A document's ids come with the byte offset of each token in the UTF-8 text; decoding is a gather from the vocabulary's
bytes.  No row is shuffled.  The driver reads the vocabulary's file and broadcasts it (about 1 MB), so executors don't need it.

Defined results: a null text has null ids and offsets; the empty text has empty ones; a very long text is a list like any other.  Text
that looks like a special token is ordinary text.  Bytes that are no UTF-8 become U+FFFD first.  A null id stays null; repeated rows each
get a row; an empty table gives an empty result; further columns are not read.  detokenize() gives no text for a row with a
null in its ids or an id that the vocabulary lacks, and the place of the first such id; Codec.decode() raises an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .frames import text_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, ids array<int>, offsets array<int>, intact boolean"
BANK, LONG_PIECE, NO_TOKEN = 300_000, 64, 1 << 30
BLOCK, SETTLE = 128, 6

START, LETTERS, NUMBERS, OTHERS, BLANK, WHITE, WHOLE, ONE_LEFT, TWO_LEFT = range(9)  # what came before
LETTER, NUMBER, OTHER, SPACE, TAB, SHORT, LONG = range(7)  # classes; SHORT, LONG: an apostrophe before one or two letters of a contraction
STATES, CLASSES = 16, 8
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import unicodedata

    kind = np.full(0x110000, OTHER, np.uint8)
    word, _, _ = tk.tables()
    for cp in np.flatnonzero(word).tolist():
        kind[cp] = LETTER if unicodedata.category(chr(cp))[0] == "L" else NUMBER
    kind[list(WHITE_SPACE)] = TAB
    kind[32] = SPACE
    return kind


@lru_cache(maxsize=1)
def _transitions() -> np.ndarray:
    """[class (+ CLASSES at a document's start), state] -> state."""
    t = np.zeros((2 * CLASSES, STATES), np.uint8)
    for state in range(9):
        t[LETTER, state] = {TWO_LEFT: ONE_LEFT, ONE_LEFT: WHOLE}.get(state, LETTERS)
        t[NUMBER, state] = NUMBERS
        t[OTHER, state] = OTHERS
        t[SPACE, state] = BLANK
        t[TAB, state] = WHITE
        inside = state in (OTHERS, BLANK)  # then the apostrophe belongs to a run of symbols
        t[SHORT, state] = OTHERS if inside else ONE_LEFT
        t[LONG, state] = OTHERS if inside else TWO_LEFT
    t[CLASSES:] = t[:CLASSES, START][:, None]
    return t


def states(kind: np.ndarray) -> np.ndarray:
    """The automaton's state before each code point, by a blocked scan over its transition functions."""
    n = len(kind)
    table = _transitions().reshape(-1)
    rows = -(-n // BLOCK)
    grid = np.zeros((BLOCK, rows), np.intp)  # column: a block
    flat = np.zeros(rows * BLOCK, np.intp)
    flat[:n] = kind
    grid[:] = flat.reshape(rows, BLOCK).T * STATES
    every = np.repeat(np.arange(9, dtype=np.uint8)[:, None], rows, axis=1)
    for step in grid[:SETTLE]:
        every = table[step + every]
    split = np.flatnonzero((every != every[0]).any(0))  # the other blocks' functions are constant by now
    one = every[0]
    for step in grid[SETTLE:]:
        one = table[step + one]
    some = every[:, split]
    for step in grid[SETTLE:, split] if len(split) else ():
        some = table[step + some]
    functions = dict(zip(split.tolist(), some.T.tolist(), strict=True))
    into, state, ends = np.zeros(rows, np.uint8), START, one.tolist()
    for i in range(rows):
        into[i] = state
        state = functions[i][state] if i in functions else ends[i]
    out = np.empty((BLOCK, rows), np.uint8)
    for i, step in enumerate(grid):
        out[i] = into
        into = table[step + into]
    return out.T.reshape(-1)[:n]


def pieces(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each piece."""
    n = len(cps)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = _classes()[cps]
    heads = bounds[:-1][np.diff(bounds) > 0]
    first = np.zeros(n + 1, bool)
    first[heads] = True
    first[n] = True
    quote = np.flatnonzero(cps == 39)
    if len(quote):
        pad = np.append(cps, [0, 0])
        a, b = pad[quote + 1], pad[quote + 2]
        in1 = ~first[quote + 1]
        in2 = in1 & ~first[np.minimum(quote + 2, n)]
        one = in1 & np.isin(a, [ord(x) for x in "stmd"])
        two = in2 & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        kind[quote[one]], kind[quote[two]] = SHORT, LONG
    white = (kind == SPACE) | (kind == TAB)
    last_white = white & np.append(~white[1:], False) & ~first[1:]  # white space before something else in the same document
    scanned = kind.copy()
    scanned[heads] += CLASSES
    before = states(scanned)
    before[heads] = START
    run = np.where(kind == LETTER, LETTERS, np.where(kind == NUMBER, NUMBERS, OTHERS))
    cut = (before != run) & (before != BLANK) & ~((kind == LETTER) & (before >= ONE_LEFT))
    cut = np.where(white, last_white | ((before != BLANK) & (before != WHITE)), cut)
    cut[heads] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n), np.searchsorted(bounds[1:], start, side="right")


class _Bank:
    """Merged pieces by hash."""

    def __init__(self) -> None:
        self.slots = tk.Slots(16)
        self.cuts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])
        self.slots.add(h)

    def get(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, one after the other, ids of each)."""
        size = self.cuts[slot + 1] - self.cuts[slot]
        upto = np.cumsum(size)
        return self.ids[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.cuts[slot] - (upto - size), size)], size


class Codec:
    """A vocabulary of byte strings by rank, and the bank of merged pieces."""

    def __init__(self, vocabulary: bytes):
        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        order = sorted(ranks, key=ranks.__getitem__)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[[ranks[t] for t in order]] = [len(t) for t in order]
        self.size, self.at = size, np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.frombuffer(b"".join(order), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(a << 32) | b: c for t, c in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.pairs = pairs
        self.slots = tk.Slots(16)
        self.slots.add(tk.mix(np.fromiter(pairs, np.uint64, len(pairs))))
        self.becomes = np.append(np.fromiter(pairs.values(), np.int64, len(pairs)), np.int64(NO_TOKEN))  # the last: no token
        self.new, self.old = _Bank(), _Bank()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair becomes, which is its rank too; NO_TOKEN if none."""
        return self.becomes[self.slots.find(tk.mix((left << 32 | right).view(tk.U64)))]

    def merge_long(self, ids: list[int]) -> list[int]:
        """A piece merged by a heap of its pairs."""
        n, pairs = len(ids), self.pairs
        before, after, alive = [*range(-1, n - 1)], [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heappush(heap, (q, x, ids[x], ids[y]))
        return [v for v, live in zip(ids, alive, strict=True) if live]

    def merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each), from the pieces' bytes."""
        count = np.diff(bounds)
        done: dict[int, list[int]] = {i: self.merge_long(self.single[data[bounds[i] : bounds[i + 1]]].tolist()) for i in np.flatnonzero(count > LONG_PIECE).tolist()}
        piece = np.repeat(np.arange(len(count)), count)
        short = (count <= LONG_PIECE)[piece]
        ids, piece = self.single[data[short]], piece[short]
        ended: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        link = np.full(len(ids), NO_TOKEN, np.int64)  # what each token becomes with the next of its piece
        same = np.flatnonzero(piece[:-1] == piece[1:])
        link[same] = self.rank(ids[same], ids[same + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            best = np.minimum.reduceat(link << 32 | np.arange(len(link)), first)
            go = best >> 32 < NO_TOKEN
            if not go.all():  # pieces without a pair are ready
                stays = np.repeat(go, np.diff(np.append(first, len(ids))))
                ended.append((piece[~stays], ids[~stays]))
                shift = np.cumsum(~stays)
                at = best[go] & 0xFFFFFFFF
                at -= shift[at]
                ids, piece, link = ids[stays], piece[stays], link[stays]
            else:
                at = best & 0xFFFFFFFF
            if not len(ids):
                break
            ids[at] = link[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one token goes from each piece before
            ids, piece, link = ids[keep], piece[keep], link[keep]
            for x in (at, at[at > 0] - 1):
                y = x[(x + 1 < len(ids))]
                y = y[piece[y] == piece[y + 1]]
                link[x] = NO_TOKEN
                link[y] = self.rank(ids[y], ids[y + 1])
        piece, ids = np.concatenate([e[0] for e in ended]), np.concatenate([e[1] for e in ended])
        if done:
            piece = np.concatenate([piece, np.repeat(list(done), [len(x) for x in done.values()])])
            ids = np.concatenate([ids, *(np.array(x, np.int64) for x in done.values())])
        ids = ids[np.argsort(piece, kind="stable")]
        return ids, np.bincount(piece, minlength=len(count))

    def _learn(self, cps: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        col = tk.strings(cps, start, end)
        data, bounds = tk.utf8(col)
        ids, size = self.merge(data, bounds)
        raw, upto = data.tobytes(), np.cumsum(size) - size
        whole = [(i, r) for i in np.flatnonzero(size > 1).tolist() if (r := self.ranks.get(raw[bounds[i] : bounds[i + 1]])) is not None]
        if whole:  # tokens that their own pairs don't lead to
            keep = np.ones(len(ids), bool)
            for i, r in whole:
                ids[upto[i]] = r
                keep[upto[i] + 1 : upto[i] + size[i]] = False
                size[i] = 1
            ids = ids[keep]
        self.new.add(h, ids.astype(np.int32), size)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by document)."""
        if self.new.slots.size > BANK:
            self.new, self.old = _Bank(), self.new
        cps, bounds = tk.codepoints(col)
        start, end, doc = pieces(cps, bounds)
        h = tk.spans(tk.prefix(cps), start, end)
        slot = self.new.slots.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            uniq, first = np.unique(h[missing], return_index=True)
            old = self.old.slots.find(uniq)
            kept = np.flatnonzero(old >= 0)
            if len(kept):
                self.new.add(uniq[kept], *self.old.get(old[kept]))
            new = np.flatnonzero(old < 0)
            if len(new):
                self._learn(cps, uniq[new], start[missing[first[new]]], end[missing[first[new]]])
            slot[missing] = self.new.slots.find(h[missing])
        ids, size = self.new.get(slot)
        per = np.bincount(doc, weights=size, minlength=len(col)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def lacks(self, ids: np.ndarray) -> np.ndarray:
        """Which ids aren't in the vocabulary."""
        out = (ids < 0) | (ids >= len(self.size))
        return out | (self.size[np.where(out, 0, ids)] == 0)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds by token)."""
        if self.lacks(ids).any():
            raise ValueError("an id that the vocabulary lacks")
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.arange(upto[-1]) + np.repeat(self.at[ids] - upto[:-1], size)], upto


@lru_cache(maxsize=2)
def codec(vocabulary: bytes) -> Codec:
    """One a Python worker, so the bank serves all its tasks."""
    return Codec(vocabulary)


def vocabulary_of(df: DataFrame, path: str):  # noqa: ANN201
    """The vocabulary's file, read by the driver, as a broadcast variable."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids, offsets (first byte of each token) and intact (decoding gives the text back) for every row of docs."""

    shared = vocabulary_of(docs, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part in tk.slices(batch, 1):
                col = part.column(1)
                ids, cuts = c.encode(col)
                raw, upto = c.decode(ids)
                data, bounds = tk.utf8(col)
                far = upto[cuts]
                offsets = upto[:-1] - np.repeat(far[:-1], np.diff(cuts))
                same = np.diff(far) == np.diff(bounds)
                if np.array_equal(far, bounds):
                    wrong = np.flatnonzero(raw != data)
                    same[np.searchsorted(bounds[1:], wrong, side="right")] = False
                else:
                    same &= np.array([np.array_equal(raw[a:b], data[x:y]) for a, b, x, y in zip(far[:-1], far[1:], bounds[:-1], bounds[1:], strict=True)], bool)
                null = col.is_null()
                place = pa.array(cuts.astype(np.int32), mask=np.append(null.to_numpy(zero_copy_only=False), False)) if col.null_count else pa.array(cuts, pa.int32())
                n = pa.array(np.diff(cuts), pa.int64(), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), n, pa.ListArray.from_arrays(place, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(place, pa.array(offsets, pa.int32())), pa.array(same, mask=null.to_numpy(zero_copy_only=False))],
                    ["doc_id", "n_tokens", "ids", "offsets", "intact"],
                )

    return text_rows(docs).mapInArrow(work, SCHEMA)


def detokenize(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text (bytes that are no UTF-8 as U+FFFD), data (the bytes) and bad (place of the first id that can't be decoded, else null; then there is no text) for every row of rows (doc_id, ids)."""
    shared = vocabulary_of(rows, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            col = batch.column(1)
            null = col.is_null().to_numpy(zero_copy_only=False)
            n = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
            flat = col.flatten()
            gone = flat.is_null().to_numpy(zero_copy_only=False)
            ids = flat.fill_null(-1).to_numpy().astype(np.int64)
            lost = gone | c.lacks(ids)
            upto = np.concatenate([[0], np.cumsum(n)])
            raw, far = c.decode(np.where(lost, int(c.single[0]), ids))
            first = np.full(len(n), -1, np.int64)
            at = np.flatnonzero(lost)[::-1]
            doc = np.searchsorted(upto[1:], at, side="right")
            first[doc] = at - upto[doc]
            some = raw.tobytes()
            data = [None if x or b >= 0 else some[far[s] : far[e]] for x, b, s, e in zip(null, first, upto[:-1], upto[1:], strict=True)]
            text = [None if x is None else x.decode("utf-8", "replace") for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(data, pa.binary()), pa.array(first, mask=first < 0)], ["doc_id", "text", "data", "bad"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["ids"].cast("array<long>").alias("ids")).mapInArrow(work, "doc_id long, text string, data binary, bad long")
