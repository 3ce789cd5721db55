"""Files as rows: recursive scans, exclusions, hashes, and readers by extension."""

from __future__ import annotations

import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "txt", "html", "htm", "docx", "pdf")


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(filename, content) of the files under folder, at any depth, that have one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("filename"), "content")


def with_hash(files: DataFrame) -> DataFrame:
    """filename and filehash (MD5 of the content) of files (filename, content)."""
    return files.select("filename", F.md5("content").alias("filehash"))


def excluded(files: DataFrame, folders: list[str], column: str = "filename") -> DataFrame:
    """files without those that lie in one of the folders, at any depth; whole path components are compared."""
    for folder in folders:
        files = files.where(~F.startswith(F.col(column), F.lit(folder.rstrip("/") + "/")))
    return files


def restricted(files: DataFrame, names: DataFrame, column: str = "filename") -> DataFrame:
    """files whose names are among names."""
    return files.join(names.select(column).distinct(), column, "left_semi")


# readers: bytes to a document's elements (kind, text, level or page)

Element = tuple[str, str, int | None]


def read_text(content: bytes) -> list[Element]:
    return [("text", content.decode("utf-8", "replace"), None)]


_BLOCK = re.compile(r"(?is)<(script|style|nav|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>")
_PARAGRAPH = re.compile(r"(?is)<(h[1-6]|p|li|td|th|div|article|title|br)\b[^>]*>")


def read_html(content: bytes) -> list[Element]:
    """Titles and passages of a page, without scripts, styles and navigation."""
    source = _BLOCK.sub(" ", content.decode("utf-8", "replace"))
    out: list[Element] = []
    marks = list(_PARAGRAPH.finditer(source))
    for at, m in enumerate(marks):
        end = marks[at + 1].start() if at + 1 < len(marks) else len(source)
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", source[m.end() : end])).split())
        tag = m.group(1).lower()
        if text:
            out.append(("heading", text, int(tag[1])) if re.fullmatch(r"h\d", tag) else ("text", text, None))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph_text(p: ET.Element) -> str:
    parts = []
    for node in p.iter():
        if node.tag == _W + "t":
            parts.append(node.text or "")
        elif node.tag == _W + "tab":
            parts.append("\t")
        elif node.tag in (_W + "br", _W + "cr"):
            parts.append("\n")
    return "".join(parts)


def _cell(tc: ET.Element) -> str | list:
    text = "\n".join(_paragraph_text(p) for p in tc.findall(_W + "p"))
    nested = [t for t in map(_table, tc.findall(_W + "tbl")) if t]
    return [text, *nested] if tc.find(_W + "tbl") is not None else text


def _table(tbl: ET.Element) -> list[dict]:
    rows = [[_cell(tc) for tc in tr.findall(_W + "tc")] for tr in tbl.findall(_W + "tr")]
    if not rows:
        return []
    names = [c if isinstance(c, str) else c[0] for c in rows[0]]
    return [dict(zip(names, row, strict=False)) for row in rows[1:]]


def read_docx(content: bytes) -> list[Element]:
    """Paragraphs, headings (with their level) and tables (as JSON), in the order of the document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).findall(_W + "style"):
                name = s.find(_W + "name")
                styles[s.get(_W + "styleId")] = name.get(_W + "val", "") if name is not None else ""
    out: list[Element] = []
    for child in body if body is not None else ():
        if child.tag == _W + "p":
            mark = child.find(f"{_W}pPr/{_W}pStyle")
            style = mark.get(_W + "val", "") if mark is not None else ""
            level = re.search(r"heading\s*(\d+)", styles.get(style, style).lower())
            out.append(("heading", _paragraph_text(child), int(level.group(1))) if level else ("text", _paragraph_text(child), None))
        elif child.tag == _W + "tbl":
            out.append(("table", json.dumps(_table(child)), None))
    return out


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[Ddm*]\b|\bT[jJ]\b|['\"]|\bET\b|-?\d+(?:\.\d+)?", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def _pdf_string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPED.get(m[1], m[1]), token[1:-1], flags=re.S)


def read_pdf(content: bytes) -> list[Element]:
    """The text of each page's content streams, a passage a line of blocks, with the page's number from 0; for fonts of one byte a character.

    Encrypted files, and files in which no text can be read that way, raise an error: nothing is indexed that isn't text.
    """
    if not content.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    if b"/Encrypt" in content:
        raise ValueError("an encrypted PDF")
    out: list[Element] = []
    page = 0
    for head, body in _STREAM.findall(content):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body or b"/Subtype" in head or not re.search(rb"\bT[jJ]\b|['\"]\s", body):
            continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            parts: list[bytes] = []
            for token in _SHOWN.findall(block):
                if token[:1] in (b"(", b"<"):
                    parts.append(_pdf_string(token))
                elif token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"') and parts and parts[-1] != b"\n":
                    parts.append(b"\n")
                elif re.fullmatch(rb"-\d+(?:\.\d+)?", token) and float(token) <= -200 and parts and parts[-1] != b"\n":
                    parts.append(b" ")  # a wide gap inside TJ
            text = b"".join(parts).decode("cp1252", "replace").strip()
            if text:
                if sum(c.isprintable() or c.isspace() for c in text) < 0.9 * len(text):
                    raise ValueError("a PDF whose fonts aren't of one byte a character")
                out.append(("text", text, page))
        page += 1
    if not out:
        raise ValueError("a PDF without text that can be read")
    return out


def read_doc(content: bytes) -> list[Element]:
    raise ValueError("binary .doc files aren't supported; save them as .docx")


READERS: dict[str, Callable[[bytes], list[Element]]] = {"md": read_text, "txt": read_text, "html": read_html, "htm": read_html, "docx": read_docx, "doc": read_doc, "pdf": read_pdf}
#: Kinds of files that are never text: without a reader of their own they are errors.
BINARY = frozenset("ppt pptx xls xlsx odt odp ods rtf epub png jpg jpeg gif tif tiff bmp webp zip gz tar 7z exe bin parquet".split())


def register_reader(extension: str, reader: Callable[[bytes], list[Element]]) -> None:
    """A reader for files of another kind (PDF, images, tables): it runs in the Python workers, so it must be importable there."""
    READERS[extension.lower()] = reader


def elements(files: DataFrame, readers: dict[str, Callable[[bytes], list[Element]]] | None = None) -> DataFrame:
    """(filename, ordinal, kind, text, level) of files (filename, content), by the reader of each extension; other files are read as text.

    A file that its reader can't read, and one of a binary kind without a reader, is one row of kind "error" with the reason as its text, so it
    doesn't end the job and isn't taken for text; readable() and unreadable() tell them apart.
    """
    table = dict(readers or READERS)

    def read(name: str, content: bytes) -> list[Element]:
        kind = unquote(name).rpartition(".")[2].lower()
        try:
            if kind not in table and (kind in BINARY or b"\0" in content[:4096]):
                raise ValueError(f"no reader for .{kind} files")
            return table.get(kind, read_text)(content)
        except Exception as e:  # noqa: BLE001  whatever a reader meets in a broken file
            return [("error", f"{type(e).__name__}: {e}", None)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                rows += [(name, at, *element) for at, element in enumerate(read(name, bytes(content)))]
            yield pd.DataFrame(rows, columns=["filename", "ordinal", "kind", "text", "level"]).astype({"ordinal": "int32", "level": "Int32"})

    return files.select("filename", "content").mapInPandas(work, "filename string, ordinal int, kind string, text string, level int")


def readable(rows: DataFrame) -> DataFrame:
    return rows.where("kind <> 'error'")


def unreadable(rows: DataFrame) -> DataFrame:
    """(filename, reason) of the files that couldn't be read."""
    return rows.where("kind = 'error'").select("filename", F.col("text").alias("reason"))
