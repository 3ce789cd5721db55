"""A search session: build and update the index of a configuration, search it, answer questions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import splitting as S
from ..operators import chunking, conversation, maintenance, retrieval
from ..sources import files as files_
from ..sources.scratch import once
from ..sources.store import Store
from . import models
from .config import Config, DocumentSettings

TABLES = ("chunks", "postings", "norms", "file_hashes")


class SearchSession:
    def __init__(self, spark: SparkSession, config: Config, encoder: models.Encoder | None = None, reranker: models.Reranker | None = None, generator: models.Generator | None = None):
        """Encoder, re-ranker and generator are those that the configuration names, unless they are given."""
        self.spark, self.config = spark, config
        self.encoder = encoder or models.named(models.ENCODERS, config.embeddings.encoder)()
        self.reranker = reranker or models.named(models.RERANKERS, config.semantic_search.reranker)()
        self.generator = models.Cached(generator or models.named(models.GENERATORS, config.llm.type)(**config.llm.params))
        self.store = Store(spark, str(config.embeddings.embeddings_path))

    # index

    def _files(self, settings: DocumentSettings) -> DataFrame:
        found = files_.scan(self.spark, str(settings.doc_path), tuple(settings.scan_extensions))
        return files_.excluded(found, [str(p) for p in settings.exclude_paths])

    def hashes(self) -> DataFrame:
        """(filename, filehash) of all files of the configuration, now."""
        out = None
        for settings in self.config.embeddings.document_settings:
            part = files_.with_hash(self._files(settings))
            out = part if out is None else out.union(part)
        return out.distinct()

    def chunks(self, only: DataFrame | None = None) -> DataFrame:
        """The chunk table of all files, or of those named in only."""
        out = None
        sizes = self.config.embeddings.chunk_sizes
        for settings in self.config.embeddings.document_settings:
            found = self._files(settings)
            if only is not None:
                found = files_.restricted(found, only)
            kind = F.lower(F.element_at(F.split("filename", r"\."), -1))
            marked = found.where(kind == "md").select("filename", F.decode("content", "UTF-8").alias("text"))
            options = settings.additional_parser_settings.get("md", {})
            parts = [chunking.markdown(marked, sizes, options), chunking.pack_docx(files_.readable(files_.elements(found.where(kind == "docx"))), sizes)]
            parts.append(chunking.pack_pages(files_.readable(files_.elements(found.where(kind == "pdf"))).withColumnRenamed("level", "page"), sizes))
            rest = files_.readable(files_.elements(found.where(~kind.isin("md", "docx", "pdf")))).withColumnRenamed("level", "page").withColumn("page", F.lit(None).cast("int"))
            parts.append(chunking.pack_elements(rest, sizes))
            for part in parts:
                made = chunking.as_chunks(part, settings.label, settings.passage_prefix)
                out = made if out is None else out.unionByName(made)
        return out

    def unreadable(self) -> DataFrame:
        """(filename, reason) of the configuration's files that have no chunks because they can't be read."""
        out = None
        for settings in self.config.embeddings.document_settings:
            found = self._files(settings)
            part = files_.unreadable(files_.elements(found.where(F.lower(F.element_at(F.split("filename", r"\."), -1)) != "md")))
            out = part if out is None else out.union(part)
        return out

    def by_ids(self, ids: list[str]) -> DataFrame:
        """The chunks of the ids; missing ids are absent."""
        return retrieval.by_ids(self.store.read("chunks"), ids)

    def _index(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        chunks = chunks.withColumn("embedding", models.encode(F.col("text"), self.encoder))
        posted = retrieval.postings(chunks, keep=("chunk_size", "label", "source"))
        return chunks, posted, retrieval.norms(posted)

    def build(self) -> None:
        """Index everything anew."""
        hashes = self.hashes()
        chunks = self.store.write("chunks", self._index(self.chunks())[0].join(hashes, "filename"))
        posted = self.store.write("postings", retrieval.postings(chunks, keep=("chunk_size", "label", "source")))
        self.store.write("norms", retrieval.norms(posted))
        self.store.write("file_hashes", hashes)

    def update(self) -> dict[str, int]:
        """Bring the index in step with the files; counts of what was done."""
        if not self.store.exists(*TABLES):
            raise FileNotFoundError("there is no index to update")
        difference = maintenance.diff(self.hashes(), self.store.read("file_hashes")).cache()
        try:
            counts = maintenance.statistics(difference).first().asDict()
            if counts["n_new"] + counts["n_changed"] + counts["n_deleted"] == 0:
                return counts
            gone = maintenance.changed(difference).union(maintenance.deleted(difference))
            chunks = self.store.read("chunks")
            # parsed and encoded once, for three tables
            fresh = once(self._index(self.chunks(maintenance.changed_or_new(difference)))[0].join(maintenance.changed_or_new(difference), "filename"))
            dropped = maintenance.chunks_of(chunks, gone).select("chunk_id")
            posted = maintenance.without(self.store.read("postings"), dropped, "chunk_id").unionByName(retrieval.postings(fresh, keep=("chunk_size", "label", "source")))
            lengths = maintenance.without(self.store.read("norms"), dropped, "chunk_id").unionByName(retrieval.norms(retrieval.postings(fresh)))
            # the tables that read chunks are written before it is replaced; the hashes come last, so a run that broke off is done again
            self.store.write("postings", posted)
            self.store.write("norms", lengths)
            self.store.write("chunks", maintenance.without(chunks, gone, "filename", "filehash").unionByName(fresh))
            self.store.write("file_hashes", difference.where("status <> 'deleted'").select("filename", F.col("new_hash").alias("filehash")))
            return counts
        finally:
            difference.unpersist()

    def labels(self) -> list[str]:
        return sorted(r["label"] for r in maintenance.labels(self.store.read("chunks")).collect())

    # search

    def candidates(self, queries: DataFrame, label: str = "", chunk_kind: str = "") -> DataFrame:
        """Distinct (query_id, chunk_size, chunk_id) of both searches over queries (query_id, query), several of which may share an id."""
        s = self.config.semantic_search
        sizes = self.config.embeddings.chunk_sizes
        each = queries.select(F.monotonically_increasing_id().alias("version"), "query_id", C.prefixed(F.col("query"), s.query_prefix).alias("question")).cache()
        asked = each.select(F.col("version").alias("query_id"), "question")
        posted = retrieval.filtered(self.store.read("postings"), label=label)
        sparse = retrieval.sparse_top(posted, self.store.read("norms"), asked, s.max_k, by=("chunk_size",)).select("query_id", "chunk_size", "chunk_id")
        vectors = self.store.read("chunks").withColumn("vec_id", F.xxhash64("chunk_id"))
        embedded = asked.withColumn("embedding", models.encode(F.col("question"), self.encoder))
        found = sparse
        for size in sizes:
            mine = retrieval.filtered(vectors, size, label, chunk_kind, len(sizes) > 1)
            top = retrieval.dense_top(mine, embedded, s.max_k).join(mine.select("vec_id", "chunk_id"), "vec_id")
            found = found.unionByName(top.select("query_id", F.lit(size).alias("chunk_size"), "chunk_id"))
        return found.join(each.select(F.col("version"), F.col("query_id").alias("asked_by")), F.col("query_id") == F.col("version")).select(F.col("asked_by").alias("query_id"), "chunk_size", "chunk_id").distinct()

    def search(self, questions: DataFrame, label: str = "", chunk_kind: str = "", queries: DataFrame | None = None, offset: int = 0) -> DataFrame:
        """(query_id, place, chunk_id, score, avg_score, text, link, ...) for questions (query_id, question).

        queries (query_id, query) are what is searched for, the questions themselves by default; chunks are ranked by the questions.
        Without a re-ranker all candidates score 0, so they come in the order of their ids.
        """
        s = self.config.semantic_search
        asked = queries if queries is not None else questions.select("query_id", F.col("question").alias("query"))
        found = self.candidates(asked, label, chunk_kind)
        texts = self.store.read("chunks").drop("embedding", "filehash")
        score = self.reranker(F.col("question"), F.col("text")) if s.rerank and self.reranker else F.lit(0.0)
        scored = found.join(texts.drop("chunk_size"), "chunk_id").join(questions, "query_id").withColumn("score", score).withColumn("n_chars", F.length("text"))
        picked = retrieval.best_chunk_size(retrieval.top_mean(scored, ("query_id", "chunk_size")), self.config.embeddings.chunk_sizes)
        chosen = retrieval.above_cutoff(scored.join(picked, ["query_id", "chunk_size"]), s.score_cutoff)
        kept = retrieval.within_budget(chosen, s.max_char_size, offset)
        link = C.rewritten_path(F.col("source"), [(r.substring_search, r.substring_replace) for r in s.replace_output_path])
        link = C.with_heading_link(link, s.append_heading_template, F.col("heading"))
        link = C.with_suffix(link, s.append_template, {"page": F.col("page"), "heading": F.col("heading"), "chunk_size": F.col("chunk_size")})
        return kept.join(chosen, ["query_id", "chunk_id"]).withColumn("link", link)

    def answer(self, question: str, label: str = "", chunk_kind: str = "", history: DataFrame | None = None) -> dict:
        """The answer to one question with its sources; a label that the index lacks is an error; history: (session_id, turn, question, answer) of this session."""
        s = self.config.semantic_search
        retrieval.check_label(label, self.labels())
        told = ""
        if history is not None and s.max_history_length:
            last = conversation.last_turns(history, s.max_history_length)
            told = (conversation.rendered(last, last).first() or {"history": ""})["history"]
        question = models.with_history(self.generator, question, told)
        if s.hyde:
            versions = [models.hypothetical_answer(self.generator, question)]
        elif s.multiquery:
            versions = models.query_versions(self.generator, question, s.n_versions)
        else:
            versions = [question]
        asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        found = self.search(asked, label, chunk_kind, self.spark.createDataFrame([(0, v) for v in versions], "query_id long, query string"), len(told)).orderBy("place").collect()  # bounded by the budget
        context = "\n\n".join([*(r["text"] for r in found), *([told] if told else [])])
        response = self.generator(self.config.prompt_template.replace("{context}", context).replace("{question}", question))
        out = {"question": question, "response": response, "average_score": found[0]["avg_score"] if found else None, "sources": [{"link": r["link"], "text": r["text"], "score": r["score"]} for r in found]}
        if self.config.persist_response_path:
            self._persist(out)
        return out

    def _persist(self, out: dict) -> None:
        """Append the answer to the tables of answers."""
        import uuid

        store, interaction = Store(self.spark, str(self.config.persist_response_path)), str(uuid.uuid4())
        config = self.spark.createDataFrame([(self.config.model_dump_json(),)], "config string")
        known = store.read("configs") if store.exists("configs") else self.spark.createDataFrame([], "config_hash string, config string")
        store.append("configs", conversation.new_configs(config, known))
        store.append("interactions", self.spark.createDataFrame([(interaction, out["question"], out["response"], out["average_score"])], "interaction_id string, question string, response string, average_score double").withColumn("response_timestamp", F.current_timestamp()).withColumn("is_positive", F.lit(None).cast("boolean")).withColumn("comment", F.lit(None).cast("string")))
        rows = self.spark.createDataFrame([(interaction, str(uuid.uuid4()), x["link"], x["text"]) for x in out["sources"]], "interaction_id string, source_id string, link string, text string")
        store.append("bridge", rows.select("interaction_id", "source_id"))
        store.append("sources", rows.select("source_id", "link", "text"))

    def feedback(self, interaction_id: str, positive: bool, comment: str = "") -> None:
        store = Store(self.spark, str(self.config.persist_response_path))
        before = store.read("interactions")
        if before.where(F.col("interaction_id") == interaction_id).isEmpty():
            raise KeyError(interaction_id)
        store.write("interactions", conversation.with_feedback(before, self.spark.createDataFrame([(interaction_id, positive, comment)], "interaction_id string, is_positive boolean, comment string")))


def split_markdown(path: str | Path, size: int, **settings: object) -> list[tuple[str, str]]:
    """One file's chunks, on the driver; a file that can't be read has none."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError:
        return []
    return S.markdown(text, size, Path(path).name, **settings)
