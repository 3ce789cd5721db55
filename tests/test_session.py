import io
import zipfile
import zlib

import pytest
import yaml
from pyspark.sql import functions as F

from sparkquill.__main__ import talk
from sparkquill.plans import config as config_
from sparkquill.plans import models
from sparkquill.plans.session import SearchSession
from sparkquill.sources import files
from sparkquill.sources.store import Store
from sparkquill.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text: str, style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_reader():
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p('k'))}</w:tr><w:tr>{cell(p('v'))}</w:tr></w:tbl>"
    table = f"<w:tbl><w:tr>{cell(p('A'))}{cell(p('A'))}</w:tr><w:tr>{cell(p('1'))}{cell(p('2') + inner)}</w:tr></w:tbl>"
    got = files.read_docx(docx(p("Title", "Heading1") + p("text") + table))
    assert got[:2] == [("heading", "Title", 1), ("text", "text", None)]
    assert got[2][1] == '[{"A": ["2", [{"k": "v"}]]}]'
    with pytest.raises(ValueError):
        files.read_doc(b"")


def pdf(pages, compress=True, extra=b""):
    """A PDF of pages of content streams."""
    out = b"%PDF-1.4\n"
    for n, body in enumerate(pages):
        data = zlib.compress(body) if compress else body
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\n%s\nendstream\nendobj\n" % (n + 1, len(data), b" /Filter /FlateDecode" if compress else b"", data)
    return out + extra + b"%%EOF"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_reader(compress):
    one = b"BT /F1 12 Tf 72 700 Td (First \\(line\\)) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ ET\nBT <48656C6C6F> Tj ET"
    two = b"q 1 0 0 1 0 0 cm Q\nBT 1 0 0 1 72 700 Tm (caf\\351) Tj ET"
    assert files.read_pdf(pdf([one, two], compress)) == [("text", "First (line)\nsecond line", 0), ("text", "Hello", 0), ("text", "caf\u00e9", 1)]
    for broken in (b"no pdf", pdf([one], compress, b"/Encrypt 5 0 R"), pdf([b"q Q"], compress)):
        with pytest.raises(ValueError, match="PDF"):
            files.read_pdf(broken)


def test_unreadable_files_are_rows(spark):
    some = [("/a.doc", b"\xd0\xcf"), ("/b.pdf", b"%PDF-1.4 nothing"), ("/c.txt", b"text"), ("/d.xlsx", b"PK.."), ("/e.docx", b"no zip"), ("/f.dat", b"ab\0cd"), ("/g.unknown", b"plain words"), ("/h.pdf", pdf([b"BT (page one) Tj ET"]))]
    rows = files.elements(spark.createDataFrame([(n, bytearray(c)) for n, c in some], "filename string, content binary"))
    assert {r["filename"] for r in files.unreadable(rows).collect()} == {"/a.doc", "/b.pdf", "/d.xlsx", "/e.docx", "/f.dat"}
    assert {(r["filename"], r["text"]) for r in files.readable(rows).collect()} == {("/c.txt", "text"), ("/g.unknown", "plain words"), ("/h.pdf", "page one")}


def test_registries(tmp_path):
    base = {"embeddings": {"embeddings_path": str(tmp_path), "document_settings": [{"doc_path": str(tmp_path)}]}}
    assert config_.Config(**base).llm.type == "echo"
    for part in ({"llm": {"type": "nobody"}}, {"semantic_search": {"reranker": "nobody"}}, {"embeddings": base["embeddings"] | {"encoder": "nobody"}}):
        with pytest.raises(ValueError, match="known"):
            config_.Config(**(base | part))


def test_a_model_as_reranker(spark):
    rerank = models.scored_by(lambda q, t: [len(set(a.split()) & set(b.split())) for a, b in zip(q, t, strict=True)], longest=3)
    got = spark.createDataFrame([("a b", "a b c d"), ("d", "a b c d"), (None, "x")], "q string, t string").select(rerank(F.col("q"), F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == [2.0, 0.0, 0.0]


def test_html_reader():
    page = b"<html><head><style>p{}</style><script>var a='<p>no</p>'</script></head><body><nav><p>menu</p></nav><h1>T &amp; U</h1><p>one <b>two</b></p></body></html>"
    assert files.read_html(page) == [("heading", "T & U", 1), ("text", "one two", None)]


def test_scan_and_exclude(spark, tmp_path):
    for name in ("a.md", "x/b.md", "xy/c.md", "d.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = files.scan(spark, str(tmp_path), ("md",))
    assert sorted(r["filename"].rpartition("/")[2] for r in found.collect()) == ["a.md", "b.md", "c.md"]
    assert files.excluded(found, [str(tmp_path / "x")]).count() == 2


def test_store_replaces_what_it_reads(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert not store.exists("t")
    store.write("t", spark.range(3))
    store.write("t", store.read("t").where("id > 0"))
    store.append("t", spark.range(1))
    assert sorted(r["id"] for r in store.read("t").collect()) == [0, 1, 2]


@pytest.fixture
def session(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "foxes.md").write_text("# Foxes\n" + "The quick brown fox jumps over the lazy dog. " * 5)
    (docs / "ships.md").write_text("# Ships\n" + "A frigate sails the northern seas with cargo. " * 5)
    (docs / "note.txt").write_text("Bread is baked from flour and water.")
    (docs / "w.docx").write_bytes(docx(p("Metals", "Heading1") + p("Copper conducts electricity well.")))
    conf = {
        "embeddings": {"embeddings_path": str(tmp_path / "index"), "chunk_sizes": [100, 200], "document_settings": [{"doc_path": str(docs), "scan_extensions": ["md", "txt", "docx"], "label": "all"}]},
        "semantic_search": {"max_k": 5, "append_template": "#page={page}"},
        "persist_response_path": str(tmp_path / "answers"),
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(conf))
    s = SearchSession(spark, config_.load(tmp_path / "c.yaml"))
    s.build()
    return s, docs


def test_build_search_update_answer(spark, session):
    s, docs = session
    asked = spark.createDataFrame([(1, "Which metal conducts electricity?"), (2, "frigate cargo")], "query_id long, question string")
    best = {r["query_id"]: r for r in s.search(asked).where("place = 0").collect()}
    assert "Copper" in best[1]["text"] and best[1]["heading"] == "Metals"
    assert "frigate" in best[2]["text"] and best[2]["link"].endswith("#page=-1")
    assert s.search(asked, label="unknown").count() == 0
    assert s.labels() == ["all"]

    assert s.update()["n_same"] == 4
    (docs / "note.txt").write_text("Cheese is made from milk.")
    (docs / "ships.md").unlink()
    (docs / "new.txt").write_text("Volcanoes erupt lava.")
    got = s.update()
    assert (got["n_new"], got["n_changed"], got["n_deleted"], got["n_same"]) == (1, 1, 1, 2)
    texts = " ".join(r["text"] for r in s.store.read("chunks").collect())
    assert "Volcanoes" in texts and "Cheese" in texts and "Bread" not in texts and "frigate" not in texts
    left = {r["chunk_id"] for r in s.store.read("chunks").collect()}
    assert {r["chunk_id"] for r in s.store.read("postings").collect()} == left == {r["chunk_id"] for r in s.store.read("norms").collect()}

    out = s.answer("What do volcanoes erupt?")
    assert out["sources"] and "Volcanoes" in out["sources"][0]["text"]
    answers = Store(spark, str(s.config.persist_response_path))
    key = answers.read("interactions").first()["interaction_id"]
    s.feedback(key, True, "good")
    assert answers.read("interactions").first()["comment"] == "good"
    with pytest.raises(KeyError):
        s.feedback("nobody", True)


def test_config_checks(tmp_path):
    bad = {"embeddings": {"embeddings_path": "x", "document_settings": [{"doc_path": str(tmp_path / "none")}]}}
    with pytest.raises(ValueError):
        config_.Config(**bad)
    bad["embeddings"]["document_settings"] = [{"doc_path": str(tmp_path), "scan_extensions": ["exe"]}]
    with pytest.raises(ValueError):
        config_.Config(**bad)


def test_talk(spark, session):
    lines, said = iter(["Which metal conducts electricity?", ""]), []
    talk(session[0], read=lambda: next(lines), write=said.append)
    numbers = [int(x[1 : x.index("]")]) for x in said[1:]]
    assert numbers == sorted(numbers, reverse=True) and numbers[-1] == 1
    lines, said = iter(["anything", ""]), []
    talk(session[0], "nobody's", lambda: next(lines), said.append)
    assert said[0].startswith("error: unknown label")


def test_unreadable_files_of_a_configuration(spark, session):
    s, docs = session
    (docs / "broken.docx").write_bytes(b"no archive")
    assert [r["filename"].rpartition("/")[2] for r in s.unreadable().collect()] == ["broken.docx"]
    s.update()
    assert s.by_ids([r["chunk_id"] for r in s.store.read("chunks").limit(2).collect()] + ["none"]).count() == 2


def test_answers_need_a_known_label(spark, session):
    with pytest.raises(ValueError, match="unknown label"):
        session[0].answer("anything", label="nobody's")


def test_model_helpers():
    assert models.query_versions(lambda _: " a \n\nb", "q", 2) == ["a", "b"]
    with pytest.raises(ValueError):
        models.query_versions(lambda _: "a", "q", 2)
    calls = []
    g = models.Cached(lambda x: calls.append(x) or "r")
    assert g("x") == g("x") == "r" and calls == ["x"]
    assert models.with_history(g, "q", "") == "q"


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("alpha beta")
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"))
    run()
    (tmp_path / "in/b.txt").write_text("gamma")
    run()
    run()
    assert sorted(r["text"] for r in store.read("chunks").collect()) == ["alpha beta", "gamma"]
    assert sorted(r["term"] for r in store.read("postings").collect()) == ["alpha", "beta", "gamma"]
