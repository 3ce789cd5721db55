"""Scalar transforms as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .splitting import IMAGE_LINK


def prefixed(text: Column, prefix: str) -> Column:
    """A passage or query prefix."""
    return F.concat(F.lit(prefix), text)


def url_quote(text: Column) -> Column:
    """Percent-encoding of UTF-8, with letters, digits, "_.-~" and "/" left alone."""
    out = F.url_encode(text)
    for find, put in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(find), F.lit(put))
    return out


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE_LINK, "")


def collapsed_newlines(text: Column) -> Column:
    """Three or more line feeds in a row become two."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def found_metadata(text: Column, start: str) -> Column:
    """The rest of the first line that holds start, else the empty text."""
    return F.regexp_extract(text, f"{start}(.*)", 1)


def heading_of(block: Column) -> Column:
    """The heading with which a block starts, without its marks, else the empty text."""
    first = F.split(F.trim(block), "\n")[0]
    return F.when(F.trim(block).startswith("#"), F.trim(F.replace(first, F.lit("#"), F.lit("")))).otherwise("")


def envelope(text: Column, facts: dict[str, Column]) -> Column:
    """The text between stars, after its metadata; null and empty values are left out."""
    lines = [F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("") for name, value in facts.items()]
    lead = "Metadata applicable to the next chunk of text delimited by five stars:\n>> METADATA START\n"
    return F.concat(F.lit(lead), *lines, F.lit(">> METADATA END\n\n*****\n"), text, F.lit("\n*****"))


def row_xml(cells: dict[str, Column]) -> Column:
    """A row as XML text, a cell a line; nothing is escaped, null is the empty text."""
    lines = [F.concat(F.lit(f'  <col name="{name}">'), F.coalesce(value.cast("string"), F.lit("")), F.lit("</col>")) for name, value in cells.items()]
    return F.concat_ws("\n", F.lit("<row>"), *lines, F.lit("</row>"))


def without_selection_marks(text: Column) -> Column:
    return F.trim(F.replace(F.replace(text, F.lit(":unselected:"), F.lit("")), F.lit(":selected:"), F.lit("")))


def rewritten_path(path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Search and replace, rule after rule."""
    for find, put in rules:
        path = F.replace(path, F.lit(find), F.lit(put))
    return path


def with_heading_link(path: Column, template: str, heading: Column) -> Column:
    """path and the template with {heading} filled in; no heading counts as the empty one."""
    return F.concat(path, F.replace(F.lit(template), F.lit("{heading}"), F.coalesce(heading, F.lit(""))))


def with_suffix(path: Column, template: str, facts: dict[str, Column]) -> Column:
    """path and the template with {name} filled in from facts; a missing value counts as empty."""
    out = F.lit(template)
    for name, value in facts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(path, F.regexp_replace(out, r"\{\w+\}", ""))


def page_or_none(page: Column) -> Column:
    return F.coalesce(page, F.lit(-1))


def chunk_kind(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("text"))


def chunk_id(*parts: Column) -> Column:
    """A chunk's id, the same at every build."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def prompt(template: str, context: Column, question: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), context), F.lit("{question}"), question)


def heading_paths(headings: Column) -> Column:
    """For an array of (level, title) the path of headings at each place, joined by "/"."""
    start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda e: e["level"] < h["level"]), F.array(F.struct(h["level"].cast("int").alias("level"), h["title"].alias("title"))))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.array_join(F.transform(stack, lambda e: e["title"]), "/"))).alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])
