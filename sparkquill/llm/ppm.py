"""Operator 9, language identification: prediction by partial matching.

For each language a byte context tree of orders 0 to 3 is counted on a bounded, documented sample of labelled rows
(max_docs a language, chosen by a hash of the id) and then frozen.  The executors count; the driver gets the distinct runs of four bytes,
which hold the shorter ones' counts too.  A byte b after a context c costs -log2 of n(b)/(T+q)
where c has seen it (T: bytes counted in c, q: different ones), else -log2 of the escape probability q/(T+q) plus the
cost in the context one byte shorter; a context that the tree lacks is passed over for free, and below order 0 each byte
costs 8 bits.  (Escape method C, without exclusion.)  A text's code length is the sum over all its bytes; the language
with the shortest is chosen.

The frozen statistics make that cost a function of the last four bytes, so it is tabulated once (a row for each order-3
context seen in any language, and for each order-2 context for the rest) and texts are scored by table look-up: whole
texts, exact lengths, no shuffle.

Defined results: the first bytes of a text have line feeds as context, and a very long text is coded whole.  Of a labelled id with several texts
the least is learnt from.  Null and empty texts have no language (null),
lengths 0 and margin 0; ties go to the language that sorts first.  A null id stays null; repeated rows each get a row;
rows with a null language are scored but not learnt from; with no labelled row the language is null everywhere; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import text_rows

MAX_DOCS = 300
ORDER = 3
SCHEMA = "doc_id long, lang_pred string, bits_per_byte double, margin double, code_lengths array<struct<lang:string,bits:double>>"


def padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with ORDER line feeds before each text; positions of the real bytes."""
    size = np.diff(bounds)
    at = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, len(size) + 1), size)
    out = np.full(len(data) + ORDER * len(size), 10, np.uint8)
    out[at] = data
    return out, at


def count(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of ORDER + 1 bytes as numbers, times) over the texts."""
    raw, at = padded(data, bounds)
    code = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        code = code << 8 | raw[at - back]
    return np.unique(code, return_counts=True)


def count_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return count(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


class Model:
    """Cost tables of all languages, from the counts of each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        seen = np.zeros(256, bool)
        seen[10] = True
        for code, _ in counts.values():
            for k in range(ORDER + 1):
                seen[np.unique(code >> 8 * k & 255)] = True
        self.symbol = np.zeros(256, np.int64)  # 0: a byte that no sample has
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        a = self.a = int(seen.sum()) + 1
        count = {lang: [self._grams(*counts[lang], k) for k in range(ORDER + 1)] for lang in self.langs}
        ctx3 = np.unique(np.concatenate([np.unique(count[x][3][0] // a) for x in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.row = (np.arange(a**3) % (a * a) + len(ctx3)).astype(np.int32)
        self.row[ctx3] = np.arange(len(ctx3), dtype=np.int32)
        self.table = np.zeros(((len(ctx3) + a * a) * a, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            cost = np.full(a, 8.0)
            for k in range(ORDER):
                cost = self._refine(np.tile(cost.reshape(-1, a), (a if k else 1, 1)) if k else cost.reshape(1, a), count[lang][k], np.arange(a**k))
            self.table[len(ctx3) * a :, j] = cost.reshape(-1)
            top = self._refine(cost[ctx3 % (a * a)], count[lang][3], ctx3)
            self.table[: len(ctx3) * a, j] = top.reshape(-1)

    def _grams(self, code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(runs of k + 1 symbols, times)."""
        out = np.zeros(len(code), np.int64)
        for back in range(k, -1, -1):
            out = out * self.a + self.symbol[code >> 8 * back & 255]
        runs, inv = np.unique(out, return_inverse=True)
        return runs, np.bincount(inv, weights=n, minlength=len(runs)).astype(np.int64)

    def _refine(self, lower: np.ndarray, grams: tuple[np.ndarray, np.ndarray], ctx: np.ndarray) -> np.ndarray:
        """Costs by context (rows, in the order of ctx) from those one order below."""
        code, n = grams
        out = lower.copy()
        if not len(code):
            return out
        c, b = np.divmod(code, self.a)
        here, first = np.unique(c, return_index=True)
        total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(c)))
        rows = np.searchsorted(ctx, here)
        out[rows] += np.log2((total + kinds) / kinds)[:, None]
        out[np.searchsorted(ctx, c), b] = np.log2(np.repeat(total + kinds, kinds) / n)
        return out

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each text (rows) in each language (columns)."""
        out = np.zeros((len(bounds) - 1, len(self.langs)))
        if not len(data) or not self.langs:
            return out
        raw, at = padded(data, bounds)
        s = self.symbol[raw].astype(np.int32)
        ctx = (s[at - 3] * self.a + s[at - 2]) * self.a + s[at - 1]
        idx = self.row[ctx].astype(np.int64) * self.a + s[at]
        some = np.flatnonzero(np.diff(bounds) > 0)
        for j in range(len(self.langs)):
            out[some, j] = np.add.reduceat(self.table[:, j][idx], bounds[some], dtype=np.float64)
        return out


def sample(docs: DataFrame, lang_col: str, max_docs: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The counts of at most max_docs labelled texts a language, those whose ids hash lowest."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    pick = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_docs).select("doc_id", F.col("lang").alias("picked"))
    rows = text_rows(docs).where("text IS NOT NULL").join(F.broadcast(pick), "doc_id").groupBy("picked", "doc_id").agg(F.min("text").alias("text"))  # pick has at most max_docs rows a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for each in sorted(set(lang)):
                code, n = count(*tk.utf8(batch.column(1).filter(pa.array(lang == each))))
                yield pa.RecordBatch.from_arrays([pa.array([each] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    found = rows.select("picked", "text").mapInArrow(work, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = np.array(found["lang"].to_pylist(), dtype=object), found["code"].to_numpy(), found["n"].to_numpy()
    return {x: (code[lang == x], n[lang == x]) for x in sorted(set(lang))}


def identify(docs: DataFrame, lang_col: str = "lang", max_docs: int = MAX_DOCS, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred, bits_per_byte, margin (bits a byte to the runner-up) and code_lengths for every row of docs."""
    model = model or Model(sample(docs, lang_col, max_docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.table = np.asfortranarray(m.table)
        langs = np.array(m.langs, dtype=object)
        for batch in batches:
            for part in tk.slices(batch, 1):
                data, bounds = tk.utf8(part.column(1))
                size = np.diff(bounds)
                bits = m.bits(data, bounds)
                rows, k = bits.shape
                best = bits.argmin(1) if k else np.zeros(rows, np.int64)
                two = np.sort(bits, 1) if k else np.zeros((rows, 1))
                per = np.maximum(size, 1)
                pred = [langs[b] if n and k else None for b, n in zip(best, size, strict=True)]
                lengths = pa.ListArray.from_arrays(
                    pa.array(np.arange(rows + 1) * k, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(np.tile(langs, rows), pa.string()), pa.array(bits.reshape(-1))], ["lang", "bits"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(two[:, 0] / per), pa.array((two[:, 1] - two[:, 0]) / per if k > 1 else np.zeros(rows)), lengths],
                    ["doc_id", "lang_pred", "bits_per_byte", "margin", "code_lengths"],
                )

    return text_rows(docs).mapInArrow(work, SCHEMA)
