"""Operator 5, quality rules: suffix-array repetition.

Each document is a sequence of units (word runs and symbol runs, lower-cased).  A suffix array over the units of the
documents of a batch (prefix doubling; suffixes of different documents never mix) gives, with the longest common prefixes
of neighbours, each suffix's deepest LCP interval: the longest substring that starts there and occurs elsewhere in the
same document.  The spans of the maximal ones of at least min_units units are united; a document is rejected if they
cover more than max_covered of its unit characters, or if the longest repeat has more than max_longest units.

Shorter repeats count where they stand one after the other: a unit lies in a tandem if it belongs to a run of at least
TIMES copies of one period of fewer than min_units units.  A document is also rejected if tandems cover more than
max_covered of its unit characters.

Occurrences may overlap.  Documents in which no run of min_units units occurs twice can't have such a repeat, which their
hashes show; only the others reach the suffix array.  A document is worked on in one task and no row is shuffled.

Defined results: null and empty texts, and texts without a unit, have no repeat (0.0 covered, longest 0, tandem 0.0) and are kept;
very long texts are analysed whole; a document at a limit is kept;
a null id stays null; repeated rows and ties each get their own row; an empty table gives an empty result; further
columns of the input, whatever their names, are not read by score() and are returned untouched by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .frames import text_rows

MIN_UNITS = 12
TIMES = 3
MAX_COVERED = 0.3
MAX_LONGEST = 100
SCHEMA = "doc_id long, n_units long, n_repeats long, covered double, longest long, tandem double, keep boolean"


def suffix_array(sym: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Order of all suffixes.  sym: symbols, different from document to document; last: for each position the end of its document."""
    n = len(sym)
    order = np.argsort(sym, kind="stable")
    s = sym[order]
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, size) + 1
    active = order[np.repeat(size > 1, size)]
    step = 1
    while len(active):
        there = active + step
        inside = there < last[active]
        nxt = np.zeros(len(active), np.int64)
        nxt[inside] = rank[there[inside]]
        old = rank[active]
        key = old * (n + 2) + nxt
        by = np.argsort(key, kind="stable")
        key, old, active = key[by], old[by], active[by]
        m = len(key)
        head, group = np.ones(m, bool), np.ones(m, bool)
        head[1:] = key[1:] != key[:-1]
        group[1:] = old[1:] != old[:-1]
        at, first = np.flatnonzero(head), np.flatnonzero(group)
        size = np.diff(np.append(at, m))
        rank[active] = old + np.repeat(at, size) - np.repeat(first, np.diff(np.append(first, m)))
        active = active[np.repeat(size > 1, size)]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank - 1] = np.arange(n)
    return out


def longest_repeat(h: np.ndarray, doc: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each position the units of the longest substring that starts there and occurs elsewhere in its document."""
    n = len(h)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    sa = suffix_array(tk.mix(h ^ tk.mix(doc.astype(tk.U64) + tk.U64(1))), last)
    a, b = sa[:-1], sa[1:]
    room = np.where(doc[a] == doc[b], np.minimum(last[a] - a, last[b] - b), 0)
    pre = tk.prefix(h)
    lcp = np.zeros(n - 1, np.int64)
    step = 1 << max(0, int(room.max()).bit_length() - 1) if room.max() else 0
    while step:
        may = np.flatnonzero(lcp + step <= room)
        x, y, k = a[may], b[may], lcp[may]
        same = tk.spans(pre, x + k, x + k + step) == tk.spans(pre, y + k, y + k + step)
        lcp[may[same]] += step
        step >>= 1
    best[a] = lcp
    best[b] = np.maximum(best[b], lcp)
    return best


Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tandem(units: Units, docs: int, min_units: int, times: int = TIMES) -> np.ndarray:
    """The fraction of each text's unit characters in runs of at least times copies of a period of fewer than min_units units."""
    h, start, end, doc = units
    hit = np.zeros(len(h), bool)
    for period in range(1, min(min_units, len(h))):
        same = (h[period:] == h[:-period]) & (doc[period:] == doc[:-period])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        first, last = edge[::2], edge[1::2]
        long = last - first >= (times - 1) * period
        reach = np.zeros(len(h) + 1, np.int64)
        np.add.at(reach, first[long], 1)
        np.add.at(reach, last[long] + period, -1)
        hit |= np.cumsum(reach[:-1]) > 0
    chars = np.bincount(doc, weights=end - start, minlength=docs)
    return np.divide(np.bincount(doc, weights=(end - start) * hit, minlength=docs), chars, out=np.zeros(docs), where=chars > 0)


def analyse(col: pa.Array, min_units: int, units: Units | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, maximal repeats, covered fraction, longest repeat) of each text; units: those of the texts, if they are there already."""
    docs = len(col)
    h, start, end, doc = tk.units(*tk.codepoints(col)) if units is None else units
    n_units = np.bincount(doc, minlength=docs)
    chars = np.bincount(doc, weights=end - start, minlength=docs)
    repeats, covered, longest = np.zeros(docs, np.int64), np.zeros(docs), np.zeros(docs, np.int64)
    n = len(h)
    if n > min_units:
        pre = tk.prefix(h)
        at = np.arange(n - min_units + 1)
        at = at[doc[at] == doc[at + min_units - 1]]
        gram = tk.spans(pre, at, at + min_units) ^ tk.mix(doc[at].astype(tk.U64) + tk.U64(1))
        s = np.sort(gram)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        dirty = np.zeros(docs, bool)
        dirty[doc[at[tk.lookup(twice, gram) >= 0]]] = True
        sel = np.flatnonzero(dirty[doc])
        if len(sel):
            h, doc, width = h[sel], doc[sel], (end - start)[sel]
            ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
            last = np.repeat(ends, np.diff(np.append(0, ends)))
            best = longest_repeat(h, doc, last)
            np.maximum.at(longest, doc, best)
            longest[longest < min_units] = 0
            long = best >= min_units
            open_ = long.copy()
            open_[1:] &= ~((best[1:] == best[:-1] - 1) & (doc[1:] == doc[:-1]))  # else it goes on from the one before
            repeats += np.bincount(doc[open_], minlength=docs)
            reach = np.zeros(len(h) + 1, np.int64)
            i = np.flatnonzero(long)
            np.add.at(reach, i, 1)
            np.add.at(reach, i + best[i], -1)
            hit = np.cumsum(reach[:-1]) > 0
            covered += np.bincount(doc[hit], weights=width[hit], minlength=docs)
    return n_units, repeats, np.divide(covered, chars, out=np.zeros(docs), where=chars > 0), longest


def _accept(covered: np.ndarray, longest: np.ndarray, tandems: np.ndarray, max_covered: float, max_longest: int) -> np.ndarray:
    return (covered <= max_covered) & (longest <= max_longest) & (tandems <= max_covered)


def score(docs: DataFrame, min_units: int = MIN_UNITS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, n_units, n_repeats, covered, longest, tandem and keep, for every row of docs (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, 1, tk.SMALL_SLICE):
                each = tk.units(*tk.codepoints(part.column(1)))
                units, repeats, covered, longest = analyse(part.column(1), min_units, each)
                tandems = tandem(each, part.num_rows, min_units)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(units, pa.int64()), pa.array(repeats, pa.int64()), pa.array(covered), pa.array(longest, pa.int64()), pa.array(tandems), pa.array(_accept(covered, longest, tandems, max_covered, max_longest))],
                    ["doc_id", "n_units", "n_repeats", "covered", "longest", "tandem", "keep"],
                )

    return text_rows(docs).mapInArrow(work, SCHEMA)


def keep(docs: DataFrame, text_col: str = "text", min_units: int = MIN_UNITS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs that the rules accept, with all their columns."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, at, tk.SMALL_SLICE):
                each = tk.units(*tk.codepoints(part.column(at)))
                _, _, covered, longest = analyse(part.column(at), min_units, each)
                yield part.filter(pa.array(_accept(covered, longest, tandem(each, part.num_rows, min_units), max_covered, max_longest)))

    return docs.mapInArrow(work, docs.schema)
