"""Operator 10, secret scans: an incremental blob ledger.

Every version of every path is content-addressed: a blob is the SHA-256 of the text.  The ledger has a row for each blob and
scan: the (rule, version) pairs that were looked for, as hashes, and what they found.  A scan takes the distinct blobs of the versions it
is given, hashes alone, drops those for which the ledger has every pair, fetches the texts of the rest, scans each blob once with the rules
that are new to it, and joins all findings, old and new, back to every path and version that holds the blob.

NARROW are the rules that the SQL has too.  Two more take what these leave: a private key's whole body, through its END
line or to the end of its base64 block, and keywords inside identifiers or quotes, with quoted or unquoted values.  The
latter looks at the text as the rules before it leave it, so what they found counts once (if one of them changes, its
version has to go up too); a private key counts under private-key, by its BEGIN line, and under private-key-block.

Rules are regular expressions with literals of which one must occur, so most texts are turned away by a substring search.
Everything is built-in expressions.  Texts are shuffled once, by blob, to meet their copies, and with a ledger none at all if the unseen blobs
are few enough for Spark to broadcast their hashes; the join back to paths moves only hashes.  Of a secret the ledger and the result
have its SHA-256 and a mask, never the text.  No pattern has an upper length for a secret.

Defined results: a null text is no blob and has no finding; the empty text is a blob without findings; very long texts are scanned whole;
repeated rows give repeated findings, one for each row; a null path or id is kept; the findings of one rule in one blob are numbered in the
order of the text, equal secrets each counted; an empty table gives empty results, and an empty ledger is like none; further columns are not read
by scan(), and redact() and clean() return them untouched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut


class Rule(NamedTuple):
    rule: str
    version: int
    pattern: str  # the whole match is the secret, in the common part of Java's and RE2's syntax
    anchors: tuple[str, ...]  # in lower case; a match holds one of them
    after: bool = False  # looks at what the rules before it leave


NARROW = (
    Rule("aws-access-key", 1, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("akia", "asia")),
    Rule("github-token", 1, r"\bgh[pousr]_[0-9A-Za-z]{36}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack-token", 2, r"\bxox[abprs]-[0-9A-Za-z-]{10,}", ("xox",)),
    Rule("private-key", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("private key-----",)),
    Rule("json-web-token", 1, r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", ("eyj",)),
    Rule("assigned-secret", 2, r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s{0,4}[:=]\s{0,4}[\"'][^\"'\s]{8,}[\"']", ("token", "secret", "passw", "api", "access")),
)
_KEY = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_GAP = r"(?:\\[nr]|\s)*"
RULES = (
    Rule(
        "private-key-block",
        1,
        rf"-----BEGIN {_KEY}(?:[^-]*(?:-{{1,4}}[^-]+){{0,50}}-----END {_KEY}|(?:\s*[A-Za-z-]+: [^\n]*){{0,8}}(?:{_GAP}[A-Za-z0-9+/=]{{16,}}){{0,400}}(?:{_GAP}[A-Za-z0-9+/]{{1,15}}={{1,2}})?)",
        ("private key",),
    ),
    *NARROW,
    Rule(
        "assigned-secret-wide",
        2,
        r"(?i)(?:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key)[A-Za-z0-9_.-]{0,64}\\?[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}"
        r"(?:\\?\"[^\"\s\\]{8,}\\?\"|\\?'[^'\s\\]{8,}\\?'|[^\s\"'`,;()\[\]{}<>\\]{8,}+(?![(\[{]))",
        ("token", "secret", "passw", "passphrase", "api", "access"),
        after=True,
    ),
)
LEDGER = "blob binary, pairs array<bigint>, findings array<struct<rule:string,version:int,n:int,secret_sha256:string,mask:string>>"


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def pair(rule: Rule) -> Column:
    """The hash of a rule in its version."""
    return F.xxhash64(F.lit(rule.rule), F.lit(rule.version))


def _some(low: Column, rule: Rule) -> Column:
    some = F.lit(False)
    for anchor in rule.anchors:
        some = some | F.contains(low, F.lit(anchor))
    return some


def _without(rows: DataFrame, name: str, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with the matches of the rules in the column of that name, one rule after the other, replaced by [rule]; low: the text as it was, in
    lower case.  Each rule is a projection, as it names twice what those before it leave: one expression for all would double with every rule."""
    for rule in rules:
        rows = rows.withColumn(name, F.when(_some(F.col("low"), rule), F.regexp_replace(name, F.lit(rule.pattern), F.lit(f"[{rule.rule}]"))).otherwise(F.col(name)))
    return rows


def _matches(text: Column, low: Column, rule: Rule) -> Column:
    """All matches of the rule in the text, none without its literals."""
    return F.when(_some(low, rule), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """LEDGER rows for the blobs of blobs (blob, text) for which the ledger lacks a rule: the pairs it lacked and what they found."""
    rows, wanted = blobs.where("text IS NOT NULL").select("blob", "text"), F.array(*map(pair, rules))
    if ledger is not None:
        have = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("have"))  # of a blob, as many as scans and rules
        unseen = rows.select("blob").distinct().join(have, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("have", F.array().cast("array<bigint>"))).alias("pairs")).where(F.size("pairs") > 0)
        rows = rows.join(unseen, "blob")
    else:
        rows = rows.withColumn("pairs", wanted)
    one = rows.dropDuplicates(["blob"]).withColumn("low", F.lower("text"))
    for i, rule in enumerate(rules):
        if rule.after:
            one = _without(one.withColumn(f"left{i}", F.when(F.array_contains("pairs", pair(rule)) & _some(F.col("low"), rule), F.col("text"))), f"left{i}", rules[:i])

    def found(i: int, rule: Rule) -> Column:
        secrets = F.when(F.array_contains("pairs", pair(rule)), _matches(F.col(f"left{i}" if rule.after else "text"), F.col("low"), rule))
        # the match may hold the name before the value; the mask shows neither
        named = F.transform(secrets, lambda x, n: F.struct(F.lit(rule.rule).alias("rule"), F.lit(rule.version).alias("version"), (n + 1).alias("n"), F.sha2(x.cast("binary"), 256).alias("secret_sha256"), F.concat(F.substring(x, 1, 4), F.lit("..."), F.length(x).cast("string")).alias("mask")))
        return F.coalesce(named, F.array().cast("array<struct<rule:string,version:int,n:int,secret_sha256:string,mask:string>>"))

    return one.select("blob", "pairs", F.flatten(F.array(*(found(i, r) for i, r in enumerate(rules)))).alias("findings"))


def _current(finding: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a finding is by one of the rules in its version."""
    out = F.lit(False)
    for r in rules:
        out = out | ((finding["rule"] == r.rule) & (finding["version"] == r.version))
    return out


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings by path and revision, new ledger rows) of versions (doc_id, path, text; a column revision is kept, else it is 0)."""
    revision = versions["revision"].cast("int") if "revision" in versions.columns else F.lit(0)
    v = versions.select(versions["doc_id"].cast("long").alias("doc_id"), versions["path"].cast("string").alias("path"), revision.alias("revision"), versions["text"].cast("string").alias("text")).where("text IS NOT NULL")
    v = v.withColumn("blob", blob(F.col("text")))
    new = scan_blobs(v, ledger, rules)
    every = new if ledger is None else ledger.unionByName(new)
    hits = every.select("blob", F.explode_outer("findings").alias("x")).where("x IS NOT NULL")  # a filter before it would look for everything twice
    hits = hits.where(_current(F.col("x"), rules)).select("blob", "x.*")
    return v.select("doc_id", "path", "revision", "blob").join(hits, "blob").select("doc_id", "path", "revision", F.lower(F.hex("blob")).alias("blob"), "rule", "version", "n", "secret_sha256", "mask"), new


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in text_col replaced by [rule]; every row is kept."""
    mine = docs.select(*(docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)), docs[text_col].alias("text"), F.lower(docs[text_col]).alias("low"))
    return _without(mine, "text", rules).select(*(F.col("text" if c == text_col else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def clean(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(docs as redact() gives them, new ledger rows): a blob that the ledger has isn't scanned again, and only texts of blobs with findings are rewritten."""
    mine = docs.select(*(docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)), docs["text"].cast("string").alias("text"), blob(docs["text"].cast("string")).alias("blob"))
    new = cut(scan_blobs(mine.select("blob", "text"), ledger, rules))
    every = new if ledger is None else ledger.unionByName(new)
    found = every.where(F.exists("findings", lambda x: _current(x, rules))).select(F.col("blob").alias("_found")).distinct()
    met = mine.join(found, F.col("blob") == F.col("_found"), "left").withColumn("low", F.when(F.col("_found").isNotNull(), F.lower("text")))  # none has no literal of a rule
    return _without(met, "text", rules).select(*(F.col("text" if c == "text" else f"_c{i}").alias(c) for i, c in enumerate(docs.columns))), new


def kept_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in folder, if there is one yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(folder) if there else None


def document_versions(docs: DataFrame) -> DataFrame:
    """The history of the paths source/doc_id: revision 1 is the document; revision 0 the stub that it began as, a few lines with a key that was removed later."""
    known = lambda c: F.coalesce(docs[c].cast("string"), F.lit("unknown"))
    path = F.concat(known("source"), F.lit("/"), known("doc_id"))
    stub = F.concat(F.lit("source: "), known("source"), F.lit('\napi_key = "'), F.md5(known("doc_id").cast("binary")), F.lit('"\n'))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), path.alias("path"), docs["text"].cast("string").alias("text"), stub.alias("stub"))
    return rows.select("doc_id", "path", F.lit(0).alias("revision"), F.col("stub").alias("text")).union(rows.select("doc_id", "path", F.lit(1), "text"))


def scan_history(docs: DataFrame, rules: tuple[Rule, ...] = RULES, raised: str = "assigned-secret") -> DataFrame:
    """The findings in every revision of the documents, in two scans: the stubs came first, under rules of which raised was a version lower; then all revisions with the ledger of that scan."""
    history = document_versions(docs)
    before = tuple(r._replace(version=r.version - 1) if r.rule == raised else r for r in rules)
    _, ledger = scan(history.where("revision = 0"), None, before)
    return scan(history, cut(ledger), rules)[0]


def _sql() -> str:
    rules = ", ".join(f"('{r.rule}', {r.version}, '{r.pattern.replace(chr(39), chr(39) * 2)}')" for r in NARROW)
    return f"""
WITH rules AS (SELECT * FROM (VALUES {rules}) r(rule, version, pattern)),
d AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || doc_id AS path, text, 'source: ' || coalesce(source, 'unknown') || chr(10) || 'api_key = "' || md5(doc_id::VARCHAR) || '"' || chr(10) AS stub FROM documents),
h AS (SELECT doc_id, path, 0 AS revision, stub AS text FROM d UNION ALL SELECT doc_id, path, 1, text FROM d),
v AS (SELECT *, sha256(text) AS blob FROM h WHERE text IS NOT NULL),
b AS (SELECT blob, any_value(text) AS text FROM v GROUP BY blob),
m AS (SELECT blob, rule, version, {" ".join(["CASE rule", *(f"WHEN '{r.rule}' THEN regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}')" for r in NARROW), "END"])} AS f FROM b, rules),
x AS (SELECT blob, rule, version, unnest(f) AS secret, generate_subscripts(f, 1) AS n FROM m WHERE len(f) > 0)
SELECT doc_id, path, revision, blob, rule, version, n::INTEGER AS n, sha256(secret) AS secret_sha256, substr(secret, 1, 4) || '...' || length(secret) AS mask FROM x JOIN v USING (blob)
"""


SQL = _sql()
