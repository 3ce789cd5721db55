"""Operator 2, document fingerprints: I-Match.

The lexicon holds the terms whose inverse document frequency ln(N / df) over all documents lies in a band.  A document's
fingerprint is the MD5 of its distinct lexicon terms, sorted and joined by spaces; further fingerprints use randomised
lexicon subsets, which a term enters by an MD5 of the subset's number and the term.  Documents that share a fingerprint
are near copies.

The upper end of the band is a share of the documents, so the lexicon has at most (mean distinct terms a document) *
exp(idf_max) terms however large the corpus is; its size is counted before it is broadcast, and beyond broadcast_terms
the terms are joined by a shuffle instead; both ways cut the same terms.  Texts are read twice and never shuffled.

Defined results: null and empty texts, and texts without a lexicon term, have n_terms 0 and null fingerprints (so they
match nothing); they count among the N documents.  Very long texts are fingerprinted whole; terms have no ties, as they are distinct.  A null id stays null; repeated rows each get a row (and count in df);
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import text_rows

IDF_MIN, IDF_MAX, SUBSETS, DROP = 1.6, 7.6, 4, "4d"
BROADCAST_TERMS = 500_000
MERGE_AT = 1_500_000


def _fold(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    h = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
    terms = pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))
    return uniq, np.bincount(inv, weights=n).astype(np.int64), terms


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that have it) over the task's rows."""
    _, lower, _ = tk.tables()
    parts: list = []
    held = 0
    for batch in batches:
        for part in tk.slices(batch, 0):
            cps, bounds = tk.codepoints(part.column(0))
            h, start, end, doc = tk.words(cps, bounds)
            if not len(h):
                continue
            _, x = tk.distinct(doc, h)
            x.sort()
            head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            uniq, first = np.unique(h, return_index=True)
            parts.append((uniq, np.diff(np.append(head, len(x))), tk.strings(lower[cps], start[first], end[first])))
            held += len(uniq)
            if held > MERGE_AT:
                parts = [_fold(parts)]
                held = len(parts[0][0])
                if held > MERGE_AT // 2:
                    yield pa.RecordBatch.from_arrays([parts[0][2], pa.array(parts[0][1])], ["term", "n"])
                    parts, held = [], 0
    if parts:
        _, n, terms = _fold(parts)
        yield pa.RecordBatch.from_arrays([terms, pa.array(n)], ["term", "n"])


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all texts of docs (doc_id, text)."""
    return text_rows(docs).select("text").mapInArrow(_count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, idf_min: float, idf_max: float, subsets: int) -> DataFrame:
    """(term, member: which of the subsets hold it; the whole lexicon comes first)."""
    n = docs.count()
    idf = F.log(F.lit(float(n)) / F.col("df"))
    member = [F.lit(True), *(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("term"))), 1, 2) >= DROP for k in range(1, subsets + 1))]
    return frequencies(docs).where((idf >= idf_min) & (idf <= idf_max)).select("term", F.array(*member).alias("member"))


def names(subsets: int) -> list[str]:
    return ["fp_all", *(f"fp_{k}" for k in range(1, subsets + 1))]


def _by_lookup(docs: DataFrame, lex: pa.Table, subsets: int) -> DataFrame:
    terms = np.array(lex["term"].to_pylist(), dtype=object)
    order = sorted(range(len(terms)), key=terms.__getitem__)
    flags = np.array(lex["member"].to_pylist(), dtype=bool).reshape(len(terms), subsets + 1)[order].T.copy()
    shared = docs.sparkSession.sparkContext.broadcast(([terms[i].encode() for i in order], flags))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, flags = shared.value
        hashes = _hashes(terms)
        by = np.argsort(hashes)
        keys, bank = hashes[by], np.array([*terms, b""], dtype=object)
        for batch in batches:
            for part in tk.slices(batch, 1):
                h, _, _, doc = tk.words(*tk.codepoints(part.column(1)))
                at = tk.lookup(keys, h)
                hit = at >= 0
                code = np.unique(doc[hit] * len(bank) + by[at[hit]])
                d, t = np.divmod(code, len(bank))
                n = np.bincount(d, minlength=part.num_rows)
                cuts = np.concatenate([[0], np.cumsum(n)])
                cols: list[list[str | None]] = [[] for _ in flags]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    ids = t[a:b]
                    for k, col in enumerate(cols):
                        some = bank[ids[flags[k][ids]]] if k else bank[ids]
                        col.append(hashlib.md5(b" ".join(some)).hexdigest() if len(some) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.string()) for c in cols)], ["doc_id", "n_terms", *names(subsets)])

    return text_rows(docs).mapInArrow(work, "doc_id long, n_terms long, " + ", ".join(f"{x} string" for x in names(subsets)))


def _hashes(terms: list[bytes]) -> np.ndarray:
    if not terms:
        return np.zeros(0, tk.U64)
    cps, bounds = tk.codepoints(pa.array([t.decode() for t in terms], pa.string()))
    return tk.spans(tk.prefix(cps), bounds[:-1], bounds[1:])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term) for the distinct terms of rows (key, text)."""
    _, lower, _ = tk.tables()
    for batch in batches:
        for part in tk.slices(batch, 1):
            cps, bounds = tk.codepoints(part.column(1))
            h, start, end, doc = tk.words(cps, bounds)
            order = np.lexsort((h, doc))
            head = order[np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]))] if len(h) else order
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[head])), tk.strings(lower[cps], start[head], end[head])], ["key", "term"])


def _by_join(docs: DataFrame, lex: DataFrame, subsets: int) -> DataFrame:
    rows = text_rows(docs).withColumn("key", F.xxhash64("doc_id", "text"))  # rows that repeat an id and a text have the same result
    met = rows.select("key", "text").mapInArrow(_terms, "key long, term string").join(lex, "term").groupBy("key", "term").agg(F.first("member").alias("member"))
    met = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "member"))).alias("x"))

    def of(k: int) -> Column:
        kept = F.transform(F.filter("x", lambda e: F.element_at(e["member"], k + 1)), lambda e: e["term"])
        return F.when(F.size(kept) > 0, F.md5(F.array_join(kept, " ")))

    fps = [of(k).alias(name) for k, name in enumerate(names(subsets))]
    return rows.select("key", "doc_id").join(met.select("key", F.size("x").cast("long").alias("n"), *fps), "key", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_terms"), *names(subsets))


def fingerprint(docs: DataFrame, idf_min: float = IDF_MIN, idf_max: float = IDF_MAX, subsets: int = SUBSETS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, n_terms, fp_all and fp_1 ... fp_k for every row of docs (doc_id, text)."""
    lex = lexicon(docs, idf_min, idf_max, subsets)
    head = lex.limit(broadcast_terms + 1).toArrow()
    if head.num_rows <= broadcast_terms:
        return _by_lookup(docs, head, subsets)
    return _by_join(docs, lex, subsets)


SQL = """
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS terms FROM documents),
e AS (SELECT doc_id, unnest(terms) AS term FROM t),
lex AS (SELECT term FROM e GROUP BY term HAVING ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) BETWEEN 1.6 AND 7.6),
m AS (SELECT e.doc_id, e.term FROM e JOIN lex USING (term)),
f AS (SELECT doc_id, count(*) AS n,
  md5(string_agg(term, ' ' ORDER BY term)) AS fp_all,
  md5(string_agg(term, ' ' ORDER BY term) FILTER (substr(md5('1:' || term), 1, 2) >= '4d')) AS fp_1,
  md5(string_agg(term, ' ' ORDER BY term) FILTER (substr(md5('2:' || term), 1, 2) >= '4d')) AS fp_2,
  md5(string_agg(term, ' ' ORDER BY term) FILTER (substr(md5('3:' || term), 1, 2) >= '4d')) AS fp_3,
  md5(string_agg(term, ' ' ORDER BY term) FILTER (substr(md5('4:' || term), 1, 2) >= '4d')) AS fp_4
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.n, 0) AS n_terms, fp_all, fp_1, fp_2, fp_3, fp_4 FROM documents d LEFT JOIN f USING (doc_id)
"""
