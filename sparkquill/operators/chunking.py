"""Documents to chunks.  Fixed-width chunks are expressions; the other splitters are state machines, run a document a row with no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import splitting as S

SENT = 1 << 20  # characters of chunks that a task sends on at a time

def fixed(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """A row (ordinal, chunk) for each slice of width characters; an empty or null text has none."""
    n = F.ceil(F.length(text) / width).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return docs.withColumn("ordinal", F.explode(starts)).withColumn("chunk", F.substring(F.col(text), F.col("ordinal") * width + 1, F.lit(width)))


def split_with(docs: DataFrame, splitter: Callable[[str, str, int], list[tuple[str, str, int | None]]], chunk_sizes: list[int], name: str = "filename", text: str = "text") -> DataFrame:
    """(filename, chunk_size, ordinal, chunk, heading, page) for each document and chunk size; splitter: (text, name, size) to chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for who, what in zip(batch.column(0), batch.column(1), strict=True):
                who, what = who.as_py(), what.as_py()
                for size in chunk_sizes:
                    chunks = splitter(what or "", who or "", size)
                    held += sum(len(c[0]) for c in chunks)
                    rows += [(who, size, at, *chunk) for at, chunk in enumerate(chunks)]
                if held > SENT:  # chunks go on as they are made, not when those of a whole batch of texts are
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

    return docs.select(docs[name].cast("string").alias("filename"), docs[text].cast("string").alias("text")).mapInArrow(work, "filename string, chunk_size int, ordinal int, chunk string, heading string, page int")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["filename", "chunk_size", "ordinal", "chunk", "heading", "page"])


def recursive(docs: DataFrame, chunk_sizes: list[int], overlap: int = 200, separators: tuple[str, ...] = S.DEFAULT_SEPARATORS, **names: str) -> DataFrame:
    return split_with(docs, lambda text, _, size: [(c, "", None) for c in S.recursive(text, size, overlap, separators)], chunk_sizes, **names)


def separated(docs: DataFrame, chunk_sizes: list[int], overlap: int = 200, separator: str = "\n", **names: str) -> DataFrame:
    return split_with(docs, lambda text, _, size: [(c, "", None) for c in S.by_separator(text, size, overlap, separator)], chunk_sizes, **names)


def markdown(docs: DataFrame, chunk_sizes: list[int], settings: dict | None = None, **names: str) -> DataFrame:
    options = settings or {}
    return split_with(docs, lambda text, name, size: [(c, h, None) for c, h in S.markdown(text, size, name.rpartition("/")[2], **options)], chunk_sizes, **names)


def _ordered(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row a document, its elements in order in one array: what a document holds is bounded, so the array is."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", *fields))).alias("elements"))


def _pack(rows: DataFrame, key: str, fields: list[str], pack: Callable[[list, int], list[tuple[str, str, int | None]]], chunk_sizes: list[int]) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for who, items in zip(batch[key], batch["elements"], strict=True):
                values = [tuple(None if pd.isna(e[f]) else e[f] for f in fields) for e in items]
                for size in chunk_sizes:
                    out += [(who, size, at, *chunk) for at, chunk in enumerate(pack(values, size))]
            yield pd.DataFrame(out, columns=["filename", "chunk_size", "ordinal", "chunk", "heading", "page"]).astype({"chunk_size": "int32", "ordinal": "int32", "page": "Int32"})

    return _ordered(rows, key, fields).mapInPandas(work, "filename string, chunk_size int, ordinal int, chunk string, heading string, page int")


def pack_elements(rows: DataFrame, chunk_sizes: list[int], key: str = "filename", ref_compat: bool = False) -> DataFrame:
    """Chunks of element rows (key, ordinal, text, page)."""
    return _pack(rows, key, ["text", "page"], lambda e, size: [(t, "", p) for t, p in S.pack_elements(((x or "", y) for x, y in e), size, ref_compat)], chunk_sizes)


def pack_pages(rows: DataFrame, chunk_sizes: list[int], key: str = "filename", overlap: int = 200, ref_compat: bool = False) -> DataFrame:
    """Chunks of page rows (key, ordinal, text, page)."""
    return _pack(rows, key, ["text", "page"], lambda e, size: [(t, "", p) for t, p in S.pack_pages(((x or "", y) for x, y in e), size, overlap, ref_compat)], chunk_sizes)


def pack_docx(rows: DataFrame, chunk_sizes: list[int], key: str = "filename", ref_compat: bool = False) -> DataFrame:
    """Chunks of block rows (key, ordinal, kind, text, level)."""
    return _pack(rows, key, ["kind", "text", "level"], lambda e, size: [(t, h, None) for t, h in S.pack_blocks(e, size, ref_compat)], chunk_sizes)


def split_tables(tables: DataFrame, size: int, caption_ratio: int = 4) -> DataFrame:
    """(table_id, page, ordinal, chunk) of tables (table_id, page, caption, rows array<string>)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for who, page, caption, rows in zip(batch["table_id"], batch["page"], batch["caption"], batch["rows"], strict=True):
                out += [(who, page, at, c) for at, c in enumerate(S.split_table(list(rows) if rows is not None else [], caption or "", size, True, caption_ratio))]
            yield pd.DataFrame(out, columns=["table_id", "page", "ordinal", "chunk"]).astype({"ordinal": "int32"})

    kind = dict(tables.dtypes)
    return tables.select("table_id", "page", "caption", "rows").mapInPandas(work, f"table_id {kind['table_id']}, page {kind['page']}, ordinal int, chunk string")


def as_chunks(split: DataFrame, label: str = "", prefix: str = "", kind: str = "text") -> DataFrame:
    """The chunk table of split rows (filename, chunk_size, ordinal, chunk, heading, page): with ids, quoted source, label and kind."""
    source = C.url_quote(F.col("filename"))
    return split.select(
        C.chunk_id(source, F.col("chunk_size"), F.col("ordinal"), F.lit(kind)).alias("chunk_id"),
        source.alias("source"),
        F.lit(label).alias("label"),
        "filename",
        "chunk_size",
        "ordinal",
        C.prefixed(F.col("chunk"), prefix).alias("text"),
        "heading",
        C.page_or_none(F.col("page")).alias("page"),
        F.lit(kind).alias("source_chunk_type"),
    )
