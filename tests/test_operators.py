import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquill.functions import columns as C
from sparkquill.operators import chunking, conversation, layout, maintenance, retrieval


def hashes(spark, **files):
    return spark.createDataFrame([(k, v) for k, v in files.items()], "filename string, filehash string")


def names(df):
    return sorted(r[0] for r in df.select("filename").collect())


class TestDiff:
    def check(self, spark, now, before, changed_or_new, changed, deleted):
        d = maintenance.diff(hashes(spark, **now), hashes(spark, **before))
        assert names(maintenance.changed_or_new(d)) == changed_or_new
        assert names(maintenance.changed(d)) == changed
        assert names(maintenance.deleted(d)) == deleted
        return d

    def test_new_only(self, spark):
        self.check(spark, {"file1": "11111", "file2": "22222", "file3": "33333"}, {"file1": "11111", "file2": "22222"}, ["file3"], [], [])

    def test_delete_only(self, spark):
        self.check(spark, {"file1": "11111", "file2": "22222"}, {"file1": "11111", "file2": "22222", "file3": "33333"}, [], [], ["file3"])

    def test_change_only(self, spark):
        base = {"file1": "11111", "file2": "22222"}
        self.check(spark, base | {"file3": "33331", "file4": "44441"}, base | {"file3": "33333", "file4": "44444"}, ["file3", "file4"], ["file3", "file4"], [])

    def test_new_and_delete(self, spark):
        base = {"file1": "11111", "file2": "22222", "file3": "33333"}
        self.check(spark, base | {"file5": "55555"}, base | {"file4": "44444"}, ["file5"], [], ["file4"])

    def test_all_three_with_old_hash(self, spark):
        base = {"file1": "11111", "file2": "22222"}
        d = self.check(spark, base | {"file3": "33333", "file5": "55555"}, base | {"file3": "33332", "file4": "44444"}, ["file3", "file5"], ["file3"], ["file4"])
        assert maintenance.changed(d).first()["filehash"] == "33332"  # the old one, though the new is greater

    def test_repeats_copies_and_swaps(self, spark):
        before = hashes(spark, a="1", b="1").union(hashes(spark, a="1"))
        assert names(maintenance.changed(maintenance.diff(hashes(spark, a="1", b="1"), before))) == []
        gone = maintenance.deleted(maintenance.diff(hashes(spark, a="1"), before))
        assert names(maintenance.chunks_of(before, gone)) == ["b"]
        assert names(maintenance.changed(maintenance.diff(hashes(spark, a="2", b="1"), hashes(spark, a="1", b="2")))) == ["a", "b"]

    def test_empty(self, spark):
        assert maintenance.diff(hashes(spark, a="1").limit(0), hashes(spark, a="1").limit(0)).count() == 0


class TestRetrieval:
    def scored(self, spark, *rows):
        return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, n_chars int")

    def test_budget_skips_and_goes_on(self, spark):
        rows = self.scored(spark, (1, 1, 0.9, 50), (1, 2, 0.8, 60), (1, 3, 0.7, 20), (2, 9, 0.1, 500))
        got = [(r["query_id"], r["place"], r["chunk_id"]) for r in retrieval.within_budget(rows, 100).collect()]
        assert got == [(1, 0, 1), (1, 1, 3)]

    def test_budget_is_strict(self, spark):
        assert retrieval.within_budget(self.scored(spark, (1, 1, 0.9, 100)), 100).count() == 0
        assert retrieval.within_budget(self.scored(spark, (1, 1, 0.9, 99)), 110, offset=10).count() == 1

    def test_cutoff_keeps_equal(self, spark):
        rows = self.scored(spark, (1, 1, 0.5, 1), (1, 2, 0.4, 1))
        assert [r["chunk_id"] for r in retrieval.above_cutoff(rows, 0.5).collect()] == [1]
        assert retrieval.above_cutoff(rows, None).count() == 2

    def test_mean_of_at_most_five(self, spark):
        rows = self.scored(spark, *((1, i, float(i), 1) for i in range(7)), (2, 1, 3.0, 1))
        assert {r["query_id"]: r["avg_score"] for r in retrieval.top_mean(rows, ("query_id",)).collect()} == {1: 4.0, 2: 3.0}

    def test_first_listed_size_wins_a_tie(self, spark):
        means = spark.createDataFrame([(1, 512, 0.5), (1, 1024, 0.5), (2, 512, 0.1), (2, 1024, 0.2)], "query_id long, chunk_size int, avg_score double")
        got = {r["query_id"]: r["chunk_size"] for r in retrieval.best_chunk_size(means, [1024, 512]).collect()}
        assert got == {1: 1024, 2: 1024}
        assert {r["query_id"]: r["chunk_size"] for r in retrieval.best_chunk_size(means, [512, 1024]).collect()}[1] == 512

    def test_blank_texts_and_zero_vectors_are_no_candidates(self, spark):
        chunks = spark.createDataFrame([("a", "red fox"), ("b", "  "), ("c", None)], "chunk_id string, text string")
        posted = retrieval.postings(chunks)
        top = retrieval.sparse_top(posted, retrieval.norms(posted), spark.createDataFrame([(1, "fox")], "query_id long, question string"), 5)
        assert [r["chunk_id"] for r in top.collect()] == ["a"]
        v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
        q = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, embedding array<float>")
        assert [r["vec_id"] for r in retrieval.dense_top(v, q, 5, "cosine").collect()] == [2]
        assert [r["vec_id"] for r in retrieval.dense_top(v, q, 5).orderBy("score", ascending=False).collect()] == [2, 1]
        assert retrieval.dense_top(v.limit(0), q, 5).count() == 0

    def test_dense_ties_go_to_the_lower_id(self, spark):
        v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40, 0, -1)], "vec_id long, embedding array<float>").repartition(3)
        q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
        assert sorted(r["vec_id"] for r in retrieval.dense_top(v, q, 4).collect()) == [1, 2, 3, 4]

    def test_dense_in_tiles(self, spark, monkeypatch):
        rnd = random.Random(4)
        rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(300)]  # many ties
        v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        q = v.select(F.col("vec_id").alias("query_id"), "embedding")
        want = {(a, b) for a, x in rows for b, _ in sorted(((j, -sum((s - t) ** 2 for s, t in zip(x, y, strict=True))) for j, y in rows), key=lambda e: (-e[1], e[0]))[:5]}
        assert {(r["query_id"], r["vec_id"]) for r in retrieval.dense_top(v, q, 5).collect()} == want

    @pytest.mark.parametrize("metric", ["l2", "cosine"])
    @pytest.mark.parametrize("scale", [1.0, 1e7])
    def test_dense_in_parts_against_all_pairs(self, spark, monkeypatch, metric, scale):
        monkeypatch.setattr(retrieval, "QUESTIONS", 30)
        monkeypatch.setattr(retrieval, "TILE", 200)
        shares = []
        monkeypatch.setattr(retrieval, "_nearest", lambda v, part, *a, f=retrieval._nearest: shares.append(part.num_rows) or f(v, part, *a))
        rnd = random.Random(7)
        rows = [(i, [scale * rnd.choice([0.0, 1.0, -1.0, rnd.random()]) for _ in range(3)] if i % 20 else [0.0] * 3) for i in range(150)] + [(900 + i, [scale, 0.0, scale]) for i in range(20)]
        v = spark.createDataFrame([*rows, (5_000, None)], "vec_id long, embedding array<double>").repartition(3)
        dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
        score = (lambda x, y: -sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) if metric == "l2" else lambda x, y: dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))
        got = {}
        for r in retrieval.dense_top(v, v.select(F.col("vec_id").alias("query_id"), "embedding"), 6, metric).collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for i, x in rows:
            each = {j: round(score(x, y), 6) for j, y in rows if metric == "l2" or any(x) and any(y)}
            want = sorted(each.items(), key=lambda e: (-e[1], e[0]))[:6]
            mine = sorted(got.get(i, []), key=lambda e: (-e[1], e[0]))
            assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=1e-9, rel=1e-9)
            assert scale > 1 or mine == want
        assert max(shares) < 60 and sum(shares) == len(rows)  # what a task holds is of so many questions

    def test_norms_beside_weights(self, spark):
        posted = retrieval.postings(spark.createDataFrame([("a", "red fox red"), ("b", "fox")], "chunk_id string, text string"))
        beside = {r["chunk_id"]: r["norm"] for r in retrieval.with_norm(posted).collect()}
        assert beside == pytest.approx({r["chunk_id"]: r["norm"] for r in retrieval.norms(posted).collect()})
        plan = retrieval.with_norm(posted)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # texts, once

    @pytest.mark.parametrize("small", [{}, {"CHUNKS": 3, "TILE": 5}, {"BROADCAST_ROWS": 4}])
    def test_sparse_scan_equals_sparse_top(self, spark, monkeypatch, small):
        for name, value in small.items():
            monkeypatch.setattr(retrieval, name, value)
        rnd = random.Random(2)
        words = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
        rows = [(f"{w}-{i}", w, rnd.choice([None, "", "?"]) if i % 9 == 0 else words(rnd.randint(1, 4))) for i in range(60) for w in (1, 2)]  # many ties
        chunks = spark.createDataFrame([*rows, (None, 1, "a b")], "chunk_id string, size int, text string").repartition(3)
        asked = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, "z"), (None, "a"), (7, "d e f g h a")], "query_id long, question string")
        known = chunks.where("chunk_id IS NOT NULL")
        posted = retrieval.postings(known, keep=("size",))
        want = retrieval.sparse_top(retrieval.with_norm(posted), None, asked.where("query_id IS NOT NULL"), 4, ("size",))
        top = retrieval.sparse_scan(chunks, asked, 4, ("size",))
        assert sorted(map(tuple, top.collect())) == sorted(map(tuple, want.collect())) and top.columns == want.columns
        assert top._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(query_id") == 1  # the best of each task, no texts or terms
        weights = lambda some: {(r["chunk_id"], r["term"]): round(r["weight"], 12) for r in some.collect()}
        assert weights(retrieval.postings_of(known)) == weights(posted) and retrieval.postings_of(known).count() == posted.count()
        norms = {r["chunk_id"]: r["norm"] for r in retrieval.norms_of(known).collect()}
        assert norms == pytest.approx({r["chunk_id"]: r["norm"] for r in retrieval.norms(posted).collect()})
        plan = retrieval.postings_of(spark.createDataFrame(rows, "chunk_id string, size int, text string"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan

    def test_display_and_lookup(self, spark):
        rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "query_id long, chunk_id string, place int")
        assert {(r["query_id"], r["chunk_id"]): r["display"] for r in retrieval.for_display(rows).collect()} == {(1, "a"): 1, (1, "b"): 0, (2, "c"): 0}
        assert sorted(r["chunk_id"] for r in retrieval.by_ids(rows, ["c", "a", "a", "z"]).collect()) == ["a", "c"] and retrieval.by_ids(rows, []).count() == 0

    def test_mmr_against_plain_selection(self, spark):
        rnd = random.Random(9)
        rows = [(q, i, round(rnd.random(), 3), [rnd.uniform(-1, 1) for _ in range(4)]) for q in range(3) for i in range(12)]
        want = {}
        cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
        for q in range(3):
            left, chosen = {r[1]: r for r in rows if r[0] == q}, []
            while len(chosen) < 5:
                best = min(left.values(), key=lambda r: (-round(0.5 * r[2] - 0.5 * max((cos(r[3], c[3]) for c in chosen), default=0.0), 12), -r[2], r[1]))
                chosen.append(left.pop(best[1]))
            want[q] = [c[1] for c in chosen]
        got = retrieval.mmr(spark.createDataFrame(rows, "query_id long, chunk_id long, score double, embedding array<double>"), 5).orderBy("query_id", "place").collect()
        assert {q: [r["chunk_id"] for r in got if r["query_id"] == q] for q in want} == want

    def test_unknown_label_leaves_nothing(self, spark):
        df = spark.createDataFrame([("x", 512, "text")], "label string, chunk_size int, source_chunk_type string")
        assert retrieval.filtered(df, label="y").count() == 0
        assert retrieval.filtered(df, chunk_size=1024, several_sizes=False).count() == 1

    def test_mmr_prefers_difference(self, spark):
        rows = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.6, [0.0, 1.0])], "query_id long, chunk_id long, score double, embedding array<double>")
        assert [r["chunk_id"] for r in retrieval.mmr(rows, 2).orderBy("place").collect()] == [1, 3]

    def test_hot_plans(self, spark):
        scored = spark.range(100).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("chunk_id"), F.rand(1).alias("score"))
        plan = retrieval.best(scored, ("query_id",), 3)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan


class TestLayout:
    def test_first_row_as_header(self, spark):
        cells = spark.createDataFrame([("t", 2, 0, "name"), ("t", 2, 1, "age"), ("t", 3, 0, "Ann"), ("t", 3, 1, "7"), ("t", 4, 2, "extra"), ("u", 0, 0, "only")], "table_id string, row_index int, column_index int, content string")
        got = {(r["table_id"], r["row_index"], r["name"], r["content"]) for r in layout.first_row_as_header(cells).collect()}
        assert got == {("t", 3, "name", "Ann"), ("t", 3, "age", "7"), ("t", 4, None, "extra")}

    def test_header_is_sorted_once(self, spark, monkeypatch):
        monkeypatch.setattr(layout, "ROWS", 10)
        rows = [("t", r, c, None if (r, c) == (0, 1) else f"{r}x{c}") for r in range(9) for c in range(5)]
        cells = layout.together(spark.createDataFrame(rows, "table_id string, row_index int, column_index int, content string"), "table_id")
        assert cells.rdd.getNumPartitions() == 5  # of 45 rows, whatever the session says
        out = layout.first_row_as_header(cells)
        assert {(r["row_index"], r["column_index"], r["name"]) for r in out.collect()} == {(r, c, None if c == 1 else f"0x{c}") for r in range(1, 9) for c in range(5)}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Join" not in plan

    def test_small_images_go(self, spark):
        images = spark.createDataFrame([(1, 100, 100), (2, 99, 100), (3, 100, 20)], "id long, width int, height int")
        assert [r["id"] for r in layout.large_enough(images, 100, 100).collect()] == [1]

    def test_touching_boxes_meet(self, spark):
        box = "page int, box struct<x0:int,y0:int,x1:int,y1:int>, id int"
        blocks = spark.createDataFrame([(1, (0, 0, 10, 10), 1), (1, (11, 0, 20, 10), 2), (2, (0, 0, 10, 10), 3)], box)
        boxes = spark.createDataFrame([(1, (10, 10, 12, 12), 0)], box)
        assert [r["id"] for r in layout.outside(blocks, boxes).orderBy("id").collect()] == [3]

    @pytest.mark.parametrize("most", [40, 1_000_000])
    def test_outside_against_all_pairs(self, spark, monkeypatch, most):
        monkeypatch.setattr(layout, "BOXES", most)
        rnd = random.Random(6)
        side = lambda: (a := rnd.randint(0, 60), a + rnd.randint(-1, 6))  # noqa: E731  some are upside down
        some = lambda n: [(rnd.choice(["p", "q", "r", None]), i, *((x[0], y[0], x[1], y[1]) if rnd.random() > 0.02 else (None, y[0], x[1], y[1]) for x, y in [(side(), side())])) for i in range(n)]
        box = "page string, id int, box struct<x0:int,y0:int,x1:int,y1:int>"
        blocks, boxes = some(400), some(150) + [("q", 7, (3, 3, 4, 4))] * 3
        meet = lambda a, b: None not in (*a, *b) and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
        want = sorted(i for page, i, a in blocks if not any(page is not None and page == q and meet(a, b) for q, _, b in boxes))
        got = layout.outside(spark.createDataFrame(blocks, box), spark.createDataFrame(boxes, box))
        assert got.columns == ["page", "id", "box"] and sorted(r["id"] for r in got.collect()) == want and 50 < len(want) < 390

    def test_a_block_asks_few_boxes(self):
        rnd = np.random.default_rng(3)
        x, n = rnd.uniform(0, 1000, 50_000), []
        tree = layout.Tree(np.zeros(50_000, np.int64), np.column_stack([x, np.zeros(50_000), x + 1, np.full(50_000, 50.0)]))
        tree._sure = lambda *a: n.append(len(a[0])) or layout.Tree._sure(*a)
        at = rnd.uniform(0, 1000, 1_000)
        above = np.arange(1_000) % 2 * 40.0
        hit = tree.meet(np.zeros(1_000, np.int64), np.column_stack([at, above + 20, at + 50, above + 30]))
        assert (hit == (above == 0)).all() and sum(n) < 20 * 1_000  # of 50,000,000 pairs

    def test_captions(self, spark):
        b = "struct<x0:double,y0:double,x1:double,y1:double>"
        tables = spark.createDataFrame([(1, 1, (0.0, 100.0, 10.0, 200.0))], f"table_id int, page int, box {b}")
        blocks = spark.createDataFrame([(1, 1, (0.0, 80.0, 10.0, 90.0), "above"), (2, 1, (0.0, 10.0, 10.0, 20.0), "far"), (3, 1, (0.0, 210.0, 10.0, 220.0), "below")], f"block_id int, page int, box {b}, text string")
        assert layout.captions(tables, blocks).first()["caption"] == "abovebelow"

    def test_grid_and_names(self, spark):
        cells = spark.createDataFrame([(0, 0, "a", 1), (0, 1, "b", 2), (1, 0, "c", 3), (1, 0, "d", 4)], "row_index int, column_index int, content string, ordinal int")
        assert [tuple(r)[1:] for r in layout.grid(cells, [0, 1]).orderBy("row_index").collect()] == [("a", "b"), ("d", None)]
        cols = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y"), (1, 3, "x")], "t int, place int, name string")
        assert [r["unique_name"] for r in layout.unique_names(cols, "t").orderBy("place").collect()] == ["x", "x_1", "y", "x_2"]


class TestConversation:
    def test_history(self, spark):
        h = spark.createDataFrame([("s", i, f"q{i}", f"a{i}") for i in (1, 2, 3)], "session_id string, turn int, question string, answer string")
        last = conversation.last_turns(h, 2)
        assert sorted(r["turn"] for r in last.collect()) == [2, 3]
        assert conversation.last_turns(h, 0).count() == 0
        sessions = spark.createDataFrame([("s",), ("empty",)], "session_id string")
        text = {r["session_id"]: r["history"] for r in conversation.rendered(last, sessions).collect()}
        assert text["empty"] == ""
        assert text["s"].index("q3") < text["s"].index("q2")

    def test_configs_and_feedback(self, spark):
        new = spark.createDataFrame([("a",), ("a",), ("b",)], "config string")
        first = conversation.new_configs(new, spark.createDataFrame([], "config_hash string, config string"))
        assert first.count() == 2
        assert conversation.new_configs(new, first).count() == 0
        i = spark.createDataFrame([(1, None, None), (2, True, "x")], "interaction_id int, is_positive boolean, comment string")
        f = spark.createDataFrame([(1, False, "bad")], "interaction_id int, is_positive boolean, comment string")
        assert sorted(map(tuple, conversation.with_feedback(i, f).select("interaction_id", "is_positive", "comment").collect())) == [(1, False, "bad"), (2, True, "x")]


class TestColumns:
    def one(self, spark, column):
        return spark.range(1).select(column).first()[0]

    def test_quote(self, spark):
        from urllib.parse import quote

        text = "a b/ü~*-_.!'()?+&"
        assert self.one(spark, C.url_quote(F.lit(text))) == quote(text)

    def test_links(self, spark):
        assert self.one(spark, C.with_heading_link(F.lit("d"), "#h={heading}", F.lit(None).cast("string"))) == "d#h="
        assert self.one(spark, C.with_suffix(F.lit("d"), "#p={page}&{nope}", {"page": F.lit(3)})) == "d#p=3&"
        assert self.one(spark, C.rewritten_path(F.lit("aXb"), [("X", "Y"), ("Y", "Z")])) == "aZb"

    def test_texts(self, spark):
        assert self.one(spark, C.collapsed_newlines(F.lit("a\n\n\n\nb"))) == "a\n\nb"
        assert self.one(spark, C.without_images(F.lit('x ![a](b.png "t") y'))) == "x  y"
        assert self.one(spark, C.heading_of(F.lit("## A b\ntext"))) == "A b"
        assert self.one(spark, C.heading_of(F.lit("plain"))) == ""

    def test_paths(self, spark):
        heads = F.expr("array(named_struct('level',1,'title','a'),named_struct('level',2,'title','b'),named_struct('level',2,'title','c'),named_struct('level',1,'title','d'))")
        assert self.one(spark, C.heading_paths(heads)) == ["a", "a/b", "a/c", "d"]


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id int, text string")
    assert [(r["id"], r["ordinal"], r["chunk"]) for r in chunking.fixed(docs, 3).collect()] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]


def test_chunks_go_on_as_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SENT", 100)
    docs = spark.createDataFrame([(f"/{i}.md", "# A\n" + "some words here. " * 20) for i in range(30)] + [("/null.md", None), (None, "short")], "filename string, text string").coalesce(1)
    sizes, rows = [], chunking._rows
    got = chunking.markdown(docs, [64, 128])
    split = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: sizes.append(f) or split(self, f, schema))
    chunking.markdown(docs, [64, 128])
    batch = pa.RecordBatch.from_pylist([{"filename": f"/{i}.md", "text": "# A\n" + "some words here. " * 20} for i in range(30)])
    assert len(list(sizes[0](iter([batch])))) == 30  # a document at a time, not all of a batch
    assert [r["chunk"] for r in got.where("filename IS NULL").collect()] == ["short"] * 2 and got.where("filename = '/null.md'").count() == 2
    assert rows([("a", 1, 0, "b", "", None)]).num_rows == 1


def test_chunks_of_several_sizes(spark):
    docs = spark.createDataFrame([("a/b.md", "x" * 25)], "filename string, text string")
    rows = chunking.as_chunks(chunking.recursive(docs, [10, 20], overlap=0), "lab", "p: ").collect()
    assert sorted((r["chunk_size"], len(r["text"])) for r in rows) == [(10, 8), (10, 13), (10, 13), (20, 8), (20, 23)]
    assert len({r["chunk_id"] for r in rows}) == len(rows) and all(r["page"] == -1 and r["source"] == "a/b.md" for r in rows)
