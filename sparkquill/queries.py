"""The registered queries of the retrieval engine, with SQL that gives the same rows wherever SQL can.

The driver's tables play the engine's parts: documents are files (/source/lang/doc_id.md), benchmark texts are questions,
embeddings are vectors, conversations are chats, pages are HTML files; boxes and cells come from the order tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import splitting as S
from .operators import chunking, conversation, layout, maintenance, retrieval
from .sources import files as files_
from .sources.scratch import once
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOK = r"[\p{L}\p{N}]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# files

NAME = "'/' || source || '/' || lang || '/' || doc_id || '.md'"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("filename"), "text", "lang")


@query(f"SELECT {NAME} AS filename, md5(text) AS filehash FROM documents")
def file_scan_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_.with_hash(files(spark, sf_dir).withColumn("content", F.col("text").cast("binary")))


@query(f"SELECT filename FROM (SELECT {NAME} AS filename FROM documents) WHERE NOT starts_with(filename, '/src1/') AND NOT starts_with(filename, '/src2/en/')")
def exclude_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_.excluded(files(spark, sf_dir).select("filename"), ["/src1", "/src2/en/"])


@query(f"SELECT {NAME} AS filename FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def restrict_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    names = files(spark, sf_dir).join(good, "doc_id", "left_semi")
    return files_.restricted(files(spark, sf_dir).select("filename"), names)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(now, before): since before, Spanish files went, licence lines were reworded, and pages came."""
    f = files(spark, sf_dir)
    now = f.where("lang <> 'es'").select("filename", F.md5(F.replace("text", F.lit("License"), F.lit("Licence")).cast("binary")).alias("filehash"))
    pages = t(spark, sf_dir, "pages").select(F.concat(F.lit("/pages/"), "page_id", F.lit(".html")).alias("filename"), F.md5(F.col("html").cast("binary")).alias("filehash"))
    return now.union(pages), f.select("filename", F.md5(F.col("text").cast("binary")).alias("filehash"))


DIFF = f"""
WITH f AS (SELECT *, {NAME} AS filename FROM documents),
now AS (SELECT filename, md5(replace(text, 'License', 'Licence')) AS new_hash FROM f WHERE lang <> 'es' UNION ALL SELECT '/pages/' || page_id || '.html', md5(html) FROM pages),
before AS (SELECT filename, md5(text) AS old_hash FROM f),
d AS (SELECT coalesce(now.filename, before.filename) AS filename, new_hash, old_hash,
  CASE WHEN old_hash IS NULL THEN 'new' WHEN new_hash IS NULL THEN 'deleted' WHEN new_hash = old_hash THEN 'same' ELSE 'changed' END AS status
  FROM now FULL JOIN before ON now.filename = before.filename)
"""


@query(DIFF + "SELECT * FROM d")
def diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.diff(*snapshots(spark, sf_dir))


@query(DIFF + "SELECT filename, new_hash AS filehash FROM d WHERE status IN ('new', 'changed')")
def changed_or_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.changed_or_new(maintenance.diff(*snapshots(spark, sf_dir)))


@query(DIFF + "SELECT filename, old_hash AS filehash FROM d WHERE status = 'changed'")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.changed(maintenance.diff(*snapshots(spark, sf_dir)))


@query(DIFF + "SELECT filename, old_hash AS filehash FROM d WHERE status = 'deleted'")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.deleted(maintenance.diff(*snapshots(spark, sf_dir)))


@query(DIFF + "SELECT count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'deleted') AS n_deleted, count(*) FILTER (status = 'same') AS n_same, count(new_hash) AS n_scanned, count(old_hash) AS n_known, count(DISTINCT new_hash) AS n_hashes FROM d")
def update_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.statistics(maintenance.diff(*snapshots(spark, sf_dir)))


@query(DIFF + "SELECT filename, old_hash AS filehash FROM before WHERE (filename, old_hash) NOT IN (SELECT filename, old_hash FROM d WHERE status IN ('changed', 'deleted'))")
def delete_mappings_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = snapshots(spark, sf_dir)
    d = maintenance.diff(now, before)
    return maintenance.without(before, maintenance.changed(d).union(maintenance.deleted(d)), "filename", "filehash").select("filename", "filehash")


@query(DIFF + "SELECT filename, old_hash AS filehash FROM before SEMI JOIN (SELECT filename AS fn FROM d WHERE status IN ('changed', 'deleted')) x ON before.filename = x.fn")
def chunks_of_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = snapshots(spark, sf_dir)
    d = maintenance.diff(now, before)
    return maintenance.chunks_of(before, maintenance.changed(d).union(maintenance.deleted(d))).select("filename", "filehash")


@query(DIFF + "SELECT filename, new_hash AS filehash FROM now UNION ALL SELECT filename, old_hash FROM before")
def append_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = snapshots(spark, sf_dir)
    return maintenance.added(now, before)


@query("SELECT DISTINCT label FROM (SELECT source AS label FROM documents UNION ALL SELECT lang FROM documents)")
def labels_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return maintenance.labels(d.select(F.col("source").alias("label")), d.select(F.col("lang").alias("label")))


# chunks and scalar transforms


def fixed_sql(width: int) -> str:
    return f"SELECT doc_id, lang, k AS ordinal, substr(text, k * {width} + 1, {width}) AS chunk FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / {width}.0) AS BIGINT)))::INTEGER AS k FROM documents)"


@query(f"SELECT doc_id, ordinal, chunk FROM ({fixed_sql(1024)})")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(t(spark, sf_dir, "documents"), 1024).select("doc_id", "ordinal", "chunk")


@query(f"SELECT md5(source || '|1024|' || ordinal || '|text') AS chunk_id, source, 'passage: ' || chunk AS text, -1 AS page, 'text' AS source_chunk_type FROM (SELECT '/' || source || '/' || lang || '/' || doc_id || '.md' AS source, k AS ordinal, substr(text, k * 1024 + 1, 1024) AS chunk FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS k FROM documents))")
def chunk_prefix_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = chunking.fixed(files(spark, sf_dir), 1024).withColumn("chunk_size", F.lit(1024)).withColumn("heading", F.lit("")).withColumn("page", F.lit(None).cast("int"))
    return chunking.as_chunks(split, "", "passage: ").select("chunk_id", "source", "text", "page", "source_chunk_type")


@query("SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def collapse_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", C.collapsed_newlines(F.replace("text", F.lit("\n"), F.lit("\n\n\n"))).alias("text"))


@query("SELECT doc_id, regexp_replace('![' || lang || '](img/' || doc_id || '.png \"a title\") ' || text, '" + S.IMAGE_LINK + "', '', 'g') AS text FROM documents")
def remove_image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", C.without_images(F.concat(F.lit("!["), "lang", F.lit("](img/"), "doc_id", F.lit('.png "a title") '), "text")).alias("text"))


@query("SELECT doc_id, regexp_extract(text, 'icensed under (.*)', 1) AS license FROM documents")
def find_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", C.found_metadata(F.col("text"), "icensed under ").alias("license"))


@query("SELECT conv_id, turn, trim(replace(string_split(trim('## ' || role || chr(10) || text), chr(10))[1], '#', '')) AS heading FROM conversations")
def heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", C.heading_of(F.concat(F.lit("## "), "role", F.lit("\n"), "text")).alias("heading"))


@query("SELECT doc_id, 'Metadata applicable to the next chunk of text delimited by five stars:' || chr(10) || '>> METADATA START' || chr(10) || 'Document name: ' || doc_id || chr(10) || CASE WHEN coalesce(quality, 0) = 0 THEN '' ELSE 'Quality: ' || quality || chr(10) END || '>> METADATA END' || chr(10) || chr(10) || '*****' || chr(10) || text || chr(10) || '*****' AS text FROM documents LEFT JOIN labels USING (doc_id)")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.when(F.coalesce("quality", F.lit(0)) != 0, F.col("quality").cast("string"))
    return d.select("doc_id", C.envelope(F.col("text"), {"Document name": F.col("doc_id").cast("string"), "Quality": quality}).alias("text"))


def _xml(*columns: str) -> str:
    return "'<row>' || chr(10) || " + " || chr(10) || ".join(f"'  <col name=\"{c}\">' || {c} || '</col>'" for c in columns) + " || chr(10) || '</row>'"


@query(f"SELECT l_orderkey, l_linenumber, {_xml('l_partkey', 'l_returnflag', 'l_linestatus')} AS xml FROM lineitem")
def xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.row_xml({c: F.col(c) for c in ("l_partkey", "l_returnflag", "l_linestatus")}).alias("xml"))


@query("SELECT doc_id, trim(replace(replace(':selected: ' || text || ' :unselected:', ':unselected:', ''), ':selected:', '')) AS content FROM documents")
def clean_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", C.without_selection_marks(F.concat(F.lit(":selected: "), "text", F.lit(" :unselected:"))).alias("content"))


@query("SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted FROM pages")
def url_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", C.url_quote(F.col("url")).alias("quoted"))


@query("SELECT page_id, replace(replace(url, 'http://', 'https://'), 'https://', 'mirror://') AS link FROM pages")
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", C.rewritten_path(F.col("url"), [("http://", "https://"), ("https://", "mirror://")]).alias("link"))


@query("SELECT doc_id, source || '&heading=' || coalesce(nullif(lang, 'en'), '') AS link FROM documents")
def heading_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", C.with_heading_link(F.col("source"), "&heading={heading}", F.when(F.col("lang") != "en", F.col("lang"))).alias("link"))


@query("SELECT doc_id, source || '#page=' || coalesce(CASE WHEN quality = 1 THEN '1' END, '') || '&x=' AS link FROM documents LEFT JOIN labels USING (doc_id)")
def partial_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", C.with_suffix(F.col("source"), "#page={page}&x={unknown}", {"page": F.when(F.col("quality") == 1, F.lit("1"))}).alias("link"))


@query("SELECT item_id, replace(replace('C: {context}' || chr(10) || 'Q: {question}', '{context}', text), '{question}', item_id::VARCHAR) AS prompt FROM benchmark")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select("item_id", C.prompt("C: {context}\nQ: {question}", F.col("text"), F.col("item_id").cast("string")).alias("prompt"))


@query(
    """
WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_partkey AS title, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS level FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, title, level) AS k FROM o),
p AS (SELECT a.l_orderkey, a.k, string_agg(b.title::VARCHAR, '/' ORDER BY b.k) AS path FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.k <= a.k
  AND NOT EXISTS (SELECT 1 FROM r c WHERE c.l_orderkey = b.l_orderkey AND c.k > b.k AND c.k <= a.k AND c.level <= b.level) GROUP BY ALL)
SELECT l_orderkey, k::INTEGER AS k, path FROM p
"""
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    items = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", level.alias("level")))).alias("x"))
    heads = F.transform("x", lambda e: F.struct(e["level"].alias("level"), e["l_partkey"].cast("string").alias("title")))
    return items.select("l_orderkey", F.posexplode(C.heading_paths(heads)).alias("k", "path")).withColumn("k", F.col("k") + 1)


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive(files(spark, sf_dir), [512, 1024])


@query()
def separator_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.separated(files(spark, sf_dir), [1024])


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("# "), "lang", F.lit("\n"), F.replace("text", F.lit(".\n"), F.lit(".\n## Part\n")))
    return chunking.markdown(files(spark, sf_dir).withColumn("text", marked), [512, 1024], {"merge": True})


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t(spark, sf_dir, "pages").select(F.concat(F.lit("/pages/"), "page_id", F.lit(".html")).alias("filename"), F.col("html").cast("binary").alias("content"))
    return files_.elements(pages)


@query()
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_elements(spark, sf_dir)


@query()
def element_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pack_elements(page_elements(spark, sf_dir).withColumn("page", F.col("ordinal").cast("int")), [1024])


@query(
    """
WITH RECURSIVE x AS (SELECT conv_id::VARCHAR AS filename, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k, turn AS page, chr(10) || text AS text, length(text) + 1 AS n FROM conversations),
s(filename, k, part, slices, next, held) AS (SELECT filename, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT filename FROM x)
  UNION ALL SELECT x.filename, x.k,
    CASE WHEN n >= 127 OR held + n >= 128 THEN next + (held > 0)::BIGINT ELSE next END,
    CASE WHEN n >= 127 THEN (n + 127) // 128 ELSE 0 END,
    CASE WHEN n >= 127 THEN next + (held > 0)::BIGINT + (n + 127) // 128 WHEN held + n >= 128 THEN next + (held > 0)::BIGINT ELSE next END,
    CASE WHEN n >= 127 THEN 0 WHEN held + n >= 128 THEN n ELSE held + n END
  FROM s JOIN x ON x.filename = s.filename AND x.k = s.k + 1),
p AS (SELECT filename, part, string_agg(text, '' ORDER BY k) AS chunk, min(page) AS page FROM s JOIN x USING (filename, k) WHERE slices = 0 GROUP BY filename, part
  UNION ALL SELECT filename, part + i, chr(10) || substr(text, i * 128 + 1, 128), page FROM (SELECT *, unnest(range(0, slices)) AS i FROM s JOIN x USING (filename, k) WHERE slices > 0))
SELECT filename, 128 AS chunk_size, part::INTEGER AS ordinal, chunk, '' AS heading, page::INTEGER AS page FROM p
"""
)
def turn_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as elements, packed into chunks below 128 characters."""
    turns = t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("filename"), F.col("turn").cast("int").alias("ordinal"), "text", F.col("turn").cast("int").alias("page"))
    return chunking.pack_elements(turns, [128])


@query()
def page_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("filename"), F.col("turn").cast("int").alias("ordinal"), "text", F.col("turn").cast("int").alias("page"))
    return chunking.pack_pages(turns, [512])


@query()
def docx_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "heading").otherwise("text")
    blocks = t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("filename"), F.col("turn").cast("int").alias("ordinal"), kind.alias("kind"), "text", F.when(kind == "heading", F.lit(1)).alias("level"))
    return chunking.pack_docx(blocks, [512])


@query(
    """
WITH RECURSIVE x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, xml) AS k, l_linenumber, xml, 'Table below contains information about: Order ' || l_orderkey || chr(10) || '```xml table:' || chr(10) AS top
  FROM (SELECT l_orderkey, l_linenumber, """
    + _xml("l_partkey", "l_quantity", "l_returnflag")
    + """ AS xml FROM lineitem)),
s(l_orderkey, k, part, held) AS (SELECT l_orderkey, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT l_orderkey FROM x)
  UNION ALL SELECT x.l_orderkey, x.k, CASE WHEN length(top) + held + length(xml) >= 400 AND held > 0 THEN part + 1 ELSE part END, CASE WHEN length(top) + held + length(xml) >= 400 THEN length(xml) + 1 ELSE held + length(xml) + 1 END FROM s JOIN x ON x.l_orderkey = s.l_orderkey AND x.k = s.k + 1)
SELECT l_orderkey AS table_id, min(min(l_linenumber)) OVER (PARTITION BY l_orderkey)::INTEGER AS page, part::INTEGER AS ordinal, any_value(top) || string_agg(xml || chr(10), '' ORDER BY k) || '```' AS chunk FROM s JOIN x USING (l_orderkey, k) GROUP BY l_orderkey, part
"""
)
def table_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = C.row_xml({c: F.col(c) for c in ("l_partkey", "l_quantity", "l_returnflag")})
    tables = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.min("l_linenumber").cast("int").alias("page"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", xml.alias("xml")))), lambda x: x["xml"]).alias("rows"))
    return chunking.split_tables(tables.withColumn("caption", F.concat(F.lit("Order "), "table_id")), 400)


# layout


@query(
    "SELECT l_orderkey, l_linenumber, page FROM (SELECT *, l_quantity::INTEGER AS page, l_extendedprice / 100 AS x0, l_extendedprice / 100 + l_quantity AS x1, l_discount * 1000 AS y0, l_discount * 1000 + 5 AS y1 FROM lineitem) a "
    "WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size = a.page AND a.x0 <= b.p_retailprice / 2 + 1 AND b.p_retailprice / 2 <= a.x1 AND a.y0 <= 50 AND 0 <= a.y1)"
)
def bbox_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).alias("box")
    c = F.col
    blocks = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").cast("int").alias("page"), box(c("l_extendedprice") / 100, c("l_discount") * 1000, c("l_extendedprice") / 100 + c("l_quantity"), c("l_discount") * 1000 + 5))
    boxes = t(spark, sf_dir, "part").select(c("p_size").alias("page"), box(c("p_retailprice") / 2, F.lit(0.0), c("p_retailprice") / 2 + 1, F.lit(50.0)))
    return layout.outside(blocks, boxes).select("l_orderkey", "l_linenumber", "page")


@query(
    """
WITH tb AS (SELECT n_nationkey AS table_id, n_regionkey AS page, n_nationkey * 400.0 AS y0, n_nationkey * 400.0 + 100 AS y1 FROM nation),
b AS (SELECT c_custkey AS block_id, n_regionkey AS page, c_acctbal AS y0, c_acctbal + 20 AS y1, c_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT table_id, block_id, text, b.y1 < tb.y0 AS above FROM tb JOIN b USING (page) WHERE (b.y1 < tb.y0 AND tb.y0 - b.y1 < 3.5 * (b.y1 - b.y0)) OR (b.y0 > tb.y1 AND b.y0 - tb.y1 < 3.5 * (b.y1 - b.y0)))
SELECT table_id, coalesce(left(string_agg(text, chr(10) ORDER BY block_id) FILTER (above), 200), '') || coalesce(left(string_agg(text, chr(10) ORDER BY block_id) FILTER (NOT above), 200), '') AS caption FROM tb LEFT JOIN m USING (table_id) GROUP BY table_id
"""
)
def caption_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    box = lambda y0, y1: F.struct(F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(1.0).alias("x1"), y1.alias("y1")).alias("box")
    nation = t(spark, sf_dir, "nation")
    tables = nation.select(c("n_nationkey").alias("table_id"), c("n_regionkey").alias("page"), box(c("n_nationkey") * 400.0, c("n_nationkey") * 400.0 + 100))
    blocks = t(spark, sf_dir, "customer").join(nation, c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("block_id"), c("n_regionkey").alias("page"), box(c("c_acctbal"), c("c_acctbal") + 20), c("c_name").alias("text"))
    return layout.captions(tables, blocks)


@query("SELECT l_suppkey, min(l_discount) * 72 AS x0, min(l_tax) * 72 AS y0, max(l_discount) * 72 AS x1, max(l_tax) * 72 AS y1 FROM lineitem GROUP BY l_suppkey")
def bbox_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.hull(t(spark, sf_dir, "lineitem").withColumnsRenamed({"l_discount": "x", "l_tax": "y"}), ("l_suppkey",)).select("l_suppkey", "box.*")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN l_returnflag ELSE l_returnflag || '_' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS n FROM lineitem)")
def rename_dup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.unique_names(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag").select("l_orderkey", "l_linenumber", "unique_name")


@query("SELECT l_orderkey, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (l_linestatus = 'F') AS F, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_orderkey")
def cell_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = t(spark, sf_dir, "lineitem").withColumn("ordinal", F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey"))
    return layout.grid(cells, ["F", "O"], ("l_orderkey",), "l_linestatus", "l_partkey")


@query("SELECT c_nationkey, string_agg(c, chr(10) ORDER BY c) AS caption FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS c FROM customer) GROUP BY c_nationkey")
def caption_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.joined_captions(t(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "caption"), "c_nationkey")


@query("SELECT s_suppkey, n_regionkey AS page FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def page_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_regionkey").alias("original"))
    return layout.remapped(t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("page")), pages).select("s_suppkey", "page")


# retrieval

WIDTHS = (512, 1024)


def chunk_table(spark: SparkSession, sf_dir: str, widths: tuple[int, ...] = (1024,), docs: DataFrame | None = None) -> DataFrame:
    docs, out = t(spark, sf_dir, "documents") if docs is None else docs, None
    for w in widths:
        part = chunking.fixed(docs, w).select(F.concat(F.lit(f"{w}-"), "doc_id", F.lit("-"), "ordinal").alias("chunk_id"), F.lit(w).alias("chunk_size"), F.col("lang").alias("label"), F.col("chunk").alias("text"))
        out = part if out is None else out.union(part)
    return out


def single_chunks(spark: SparkSession, sf_dir: str, widths: tuple[int, ...] = (1024,), label: str = "") -> DataFrame:
    """(chunk_id, chunk_size, text) of the chunk table with one row a chunk id: only those of documents that repeat an id are shuffled."""
    docs = retrieval.filtered(t(spark, sf_dir, "documents").withColumn("label", F.col("lang")), label=label).drop("label")
    again = once(docs.groupBy(F.col("doc_id").alias("again")).count().where("count > 1"))
    chunks = lambda some: chunk_table(spark, sf_dir, widths, some).select("chunk_id", "chunk_size", "text")
    if again.isEmpty():
        return chunks(docs)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return chunks(docs.join(again, same, "left_anti")).union(retrieval.merged(chunks(docs.join(again, same, "left_semi")), keep=("chunk_size",)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def sparse(spark: SparkSession, sf_dir: str, widths: tuple[int, ...] = (1024,), label: str = "", k: int = 15) -> DataFrame:
    return retrieval.sparse_scan(single_chunks(spark, sf_dir, widths, label), questions(spark, sf_dir), k, ("chunk_size",))


def chunks_cte(widths: tuple[int, ...] = (1024,)) -> str:
    return "c AS (" + " UNION ALL ".join(f"SELECT '{w}-' || doc_id || '-' || ordinal AS chunk_id, {w} AS chunk_size, lang AS label, chunk AS text FROM ({fixed_sql(w)})" for w in widths) + ")"


def sparse_cte(widths: tuple[int, ...] = (1024,), where: str = "true", k: int = 15) -> str:
    return f"""{chunks_cte(widths)},
p AS (SELECT chunk_id, chunk_size, term, ln(1 + count(*)) AS w FROM (SELECT chunk_id, chunk_size, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM c WHERE {where}) GROUP BY ALL),
pn AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM p GROUP BY ALL),
q AS (SELECT query_id, term, ln(1 + count(*)) AS w FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM benchmark) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM q GROUP BY ALL),
sp AS (SELECT query_id, chunk_size, chunk_id, round(dot / pn.norm / qn.norm, 6) AS score FROM (SELECT query_id, chunk_size, chunk_id, sum(p.w * q.w) AS dot FROM p JOIN q USING (term) GROUP BY ALL) JOIN pn USING (chunk_id) JOIN qn USING (query_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_size ORDER BY score DESC, chunk_id) <= {k})"""


@query(f"WITH {chunks_cte()} SELECT chunk_id, term, round(ln(1 + count(*)), 6) AS weight FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM c) GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings_of(single_chunks(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {sparse_cte()} SELECT chunk_id, round(norm, 6) AS norm FROM pn")
def sparse_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.norms_of(single_chunks(spark, sf_dir)).withColumn("norm", F.round("norm", 6))


@query(f"WITH {sparse_cte()} SELECT * FROM sp")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(spark, sf_dir)


@query(f"WITH {sparse_cte(where=chr(39).join(['label = ', 'de', '']))} SELECT * FROM sp")
def sparse_topk_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(spark, sf_dir, label="de")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = t(spark, sf_dir, "embeddings")
    return v, v.select(F.col("vec_id").alias("query_id"), "embedding")


def dense_cte(metric: str = "l2", where: str = "true") -> str:
    s = "-list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" if metric == "l2" else "list_cosine_similarity(a.e, b.e)"
    return f"v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), dn AS (SELECT a.vec_id AS query_id, b.vec_id, round({s}, 6) + 0.0 AS score FROM v a, v b WHERE {where} QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 15)"


@query(f"WITH {dense_cte()} SELECT * FROM dn")
def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_top(*vectors(spark, sf_dir), 15)


@query(f"WITH {dense_cte('cosine')} SELECT * FROM dn")
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_top(*vectors(spark, sf_dir), 15, "cosine")


@query(f"WITH {dense_cte(where='b.label = 3')} SELECT * FROM dn")
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_top(*vectors(spark, sf_dir), 15, where={"label": 3})


#: vec_id and doc_id have no declared relation; that vector n belongs to the first chunk of document n is this module's convention.
HYBRID = f"{sparse_cte()}, {dense_cte()}, u AS (SELECT query_id, chunk_id FROM sp UNION SELECT query_id, '1024-' || vec_id || '-0' FROM dn WHERE query_id IN (SELECT item_id FROM benchmark))"


@query(f"WITH {HYBRID} SELECT * FROM u")
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    q = q.join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    dense = retrieval.dense_top(v, q, 15).select("query_id", F.concat(F.lit("1024-"), "vec_id", F.lit("-0")).alias("chunk_id"))
    return retrieval.union_candidates(sparse(spark, sf_dir), dense)


@query(f"WITH {sparse_cte()} SELECT DISTINCT query_id // 2 AS query_id, chunk_size, chunk_id FROM sp")
def multiquery_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring questions as two versions of one."""
    return retrieval.union_candidates(sparse(spark, sf_dir).withColumn("query_id", F.floor(F.col("query_id") / 2)), by=("query_id", "chunk_size", "chunk_id"))


RERANK = f"""
r AS (SELECT sp.query_id, sp.chunk_size, chunk_id, c.text, length(c.text) AS n_chars,
  round((CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, regexp_extract_all(lower(c.text), '{TOK}'))) / len(qt)::DOUBLE ELSE 0.0 END) - least(length(c.text) / 1e6, 0.1), 6) AS score
  FROM sp JOIN c USING (chunk_id) JOIN (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{TOK}')) AS qt FROM benchmark) USING (query_id))
"""
MEANS = "a AS (SELECT query_id, chunk_size, round(avg(score), 6) AS avg_score FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, chunk_size ORDER BY score DESC, chunk_id) <= 5) GROUP BY ALL)"
BEST = "w AS (SELECT query_id, chunk_size, avg_score FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY avg_score DESC, chunk_size) = 1)"
PACK = """
o AS (SELECT r.query_id, chunk_id, n_chars, text, row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, chunk_id) AS k FROM r JOIN w USING (query_id, chunk_size) WHERE score >= 0.1),
f(query_id, k, used, kept) AS (SELECT query_id, 0::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT query_id FROM o)
  UNION ALL SELECT o.query_id, o.k, CASE WHEN f.used + o.n_chars < 4096 THEN f.used + o.n_chars ELSE f.used END, f.used + o.n_chars < 4096 FROM f JOIN o ON o.query_id = f.query_id AND o.k = f.k + 1),
pk AS (SELECT query_id, chunk_id, text, (row_number() OVER (PARTITION BY query_id ORDER BY k) - 1)::INTEGER AS place FROM f JOIN o USING (query_id, k) WHERE kept)
"""


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, texts = once(sparse(spark, sf_dir, WIDTHS)), chunk_table(spark, sf_dir, WIDTHS)
    few = top.select("query_id", "chunk_size", "chunk_id")
    few = F.broadcast(few) if few.count() <= retrieval.BROADCAST_ROWS else few  # else every text would be shuffled
    got = texts.drop("chunk_size").join(few, "chunk_id").join(F.broadcast(questions(spark, sf_dir)), "query_id")  # k rows a question and size
    return once(got.withColumn("score", retrieval.overlap_score(F.col("question"), F.col("text"))).withColumn("n_chars", F.length("text")))  # read several times below


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, place, chunk_id, text).  Texts go along, as a chunk id may have several."""
    r = reranked(spark, sf_dir)
    w = retrieval.best_chunk_size(retrieval.top_mean(r, ("query_id", "chunk_size")), list(WIDTHS))
    chosen = retrieval.above_cutoff(r.join(w, ["query_id", "chunk_size"]), 0.1).withColumn("chunk_id", F.struct("chunk_id", "text"))
    return retrieval.within_budget(chosen, 4096).select("query_id", "place", "chunk_id.chunk_id", "chunk_id.text")


@query(f"WITH {sparse_cte(WIDTHS)}, {RERANK}, {MEANS} SELECT * FROM a")
def rerank_top5_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_mean(reranked(spark, sf_dir), ("query_id", "chunk_size"))


@query(f"WITH {sparse_cte(WIDTHS)}, {RERANK}, {MEANS}, {BEST} SELECT * FROM w")
def best_chunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_chunk_size(retrieval.top_mean(reranked(spark, sf_dir), ("query_id", "chunk_size")), list(WIDTHS))


@query(f"WITH {sparse_cte(WIDTHS)}, {RERANK} SELECT query_id, chunk_id, score FROM r WHERE score >= 0.1")
def score_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.above_cutoff(reranked(spark, sf_dir), 0.1).select("query_id", "chunk_id", "score")


@query(f"WITH RECURSIVE {sparse_cte(WIDTHS)}, {RERANK}, {MEANS}, {BEST}, {PACK} SELECT query_id, place, chunk_id FROM pk")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).drop("text")


@query(f"WITH RECURSIVE {sparse_cte(WIDTHS)}, {RERANK}, {MEANS}, {BEST}, {PACK} SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY place) AS context FROM pk GROUP BY query_id")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to contexts: chunks of two sizes, sparse top-15, re-ranking, choice of size, cutoff, budget."""
    return retrieval.in_order(packed(spark, sf_dir))


@query(
    f"WITH {dense_cte()}, {dense_cte('cosine').replace('v AS (', 'v2 AS (').replace('dn AS', 'dc AS')}, "
    "r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM dn UNION ALL SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) FROM dc) "
    "SELECT query_id, vec_id AS chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM r GROUP BY query_id, vec_id"
)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return retrieval.reciprocal_rank_fusion(*(retrieval.dense_top(v, q, 15, m).withColumnRenamed("vec_id", "chunk_id") for m in ("l2", "cosine")))


@query()
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    top = retrieval.dense_top(v, q, 15, "cosine").join(v.select("vec_id", "embedding"), "vec_id").withColumnRenamed("vec_id", "chunk_id")
    return retrieval.mmr(top, 5)


@query(f"WITH {chunks_cte(WIDTHS)} SELECT chunk_id, text FROM c WHERE chunk_size = 512 AND label = 'fr'")
def chunks_of_size_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.filtered(chunk_table(spark, sf_dir, WIDTHS), 512, "fr").select("chunk_id", "text")


@query("SELECT event_id, coalesce(nullif(event_type, 'view'), 'text') AS source_chunk_type FROM events WHERE coalesce(nullif(event_type, 'view'), 'text') = 'text'")
def chunk_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = t(spark, sf_dir, "events").withColumn("source_chunk_type", C.chunk_kind(F.when(F.col("event_type") != "view", F.col("event_type"))))
    return retrieval.filtered(kinds, chunk_kind="text").select("event_id", "source_chunk_type")


@query("SELECT item_id, 'query: ' || text AS question FROM benchmark")
def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select("item_id", C.prefixed(F.col("text"), "query: ").alias("question"))


@query(f"WITH {chunks_cte()} SELECT chunk_id, label, text FROM c WHERE chunk_id IN ('1024-0-0', '1024-7-0', '1024-7-1', '1024-199-0')")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_ids(chunk_table(spark, sf_dir), ["1024-0-0", "1024-7-0", "1024-7-1", "1024-199-0", "1024-0-0", "not there"]).select("chunk_id", "label", "text")


@query(f"WITH {sparse_cte()} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id DESC)::INTEGER - 1 AS display FROM sp")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = sparse(spark, sf_dir)
    ranked = retrieval.best(top, ("query_id",), 15).withColumn("place", F.col("rank") - 1)
    return retrieval.for_display(ranked).select("query_id", "chunk_id", "display")


@query("SELECT s_nationkey AS page, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)::INTEGER - 1 AS place, s_acctbal AS x0, s_suppkey::DOUBLE AS y0 FROM supplier")
def boxes_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.col("s_acctbal").alias("x0"), F.col("s_suppkey").cast("double").alias("y0"), (F.col("s_acctbal") + 1).alias("x1"), (F.col("s_suppkey") + 1.0).alias("y1"))
    by = layout.boxes_by_page(t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), box.alias("box")))
    return by.select("page", F.posexplode("boxes").alias("place", "b")).select("page", "place", "b.x0", "b.y0")


@query(
    "WITH c AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey)::INTEGER AS row_index, l_returnflag AS column_index, l_partkey::VARCHAR AS content FROM lineitem) "
    "SELECT a.table_id, a.row_index, a.column_index, b.content AS name, a.content FROM c a JOIN c b ON a.table_id = b.table_id AND a.column_index = b.column_index AND b.row_index = 1 WHERE a.row_index > 1"
)
def header_from_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey"))
    lines = layout.together(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey").where("l_orderkey IS NOT NULL AND l_returnflag IS NOT NULL"), "l_orderkey")
    cells = lines.select(F.col("l_orderkey").alias("table_id"), nth.alias("row_index"), F.col("l_returnflag").alias("column_index"), F.col("l_partkey").cast("string").alias("content"))
    return layout.first_row_as_header(cells)


@query("SELECT p_partkey, p_size AS width, p_retailprice AS height FROM part WHERE p_size >= 20 AND p_retailprice >= 950")
def image_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("width"), F.col("p_retailprice").alias("height"))
    return layout.large_enough(images, 20, 950)


# conversations and answers

PAIRS = "pr AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


@query(f"WITH {PAIRS} SELECT conv_id, turn, question, answer FROM pr QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.last_turns(conversation.pairs(t(spark, sf_dir, "conversations")), 2, "conv_id").drop("age")


@query(f"WITH {PAIRS} SELECT conv_id, coalesce(history, '') AS history FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, 'Previous questions and answers, newest first:' || chr(10) || string_agg('Question: ' || question || chr(10) || 'Answer: ' || answer || chr(10), '' ORDER BY turn DESC) AS history FROM pr GROUP BY conv_id) USING (conv_id)")
def history_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    return conversation.rendered(conversation.pairs(c), c, "conv_id")


@query("SELECT o_orderkey, l_partkey, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def interaction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers, line items as the bridge, parts as sources."""
    interactions = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("interaction_id"))
    bridge = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("interaction_id"), F.col("l_partkey").alias("source_id"))
    sources = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), "p_name")
    return conversation.responses(interactions, bridge, sources).select(F.col("interaction_id").alias("o_orderkey"), F.col("source_id").alias("l_partkey"), "p_name")


@query("WITH e AS (SELECT event_type, user_id || ' ' || props AS config FROM events) SELECT DISTINCT md5(config) AS config_hash, config FROM e WHERE event_type <> 'click' AND config NOT IN (SELECT config FROM e WHERE event_type = 'click')")
def config_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("event_type", F.concat("user_id", F.lit(" "), "props").alias("config"))
    return conversation.new_configs(e.where("event_type <> 'click'"), e.where("event_type = 'click'").select(F.md5("config").alias("config_hash")))


@query("SELECT d.doc_id AS interaction_id, quality = 1 AS is_positive, CASE WHEN quality IS NOT NULL THEN 'toxic: ' || toxic END AS comment FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def feedback_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    interactions = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("interaction_id"), F.lit(None).cast("boolean").alias("is_positive"), F.lit(None).cast("string").alias("comment"))
    feedback = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("interaction_id"), (F.col("quality") == 1).alias("is_positive"), F.concat(F.lit("toxic: "), "toxic").alias("comment"))
    return conversation.with_feedback(interactions, feedback)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(t(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
