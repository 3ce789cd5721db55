"""Operator 8, toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are character 5-grams and 7-grams inside words (a word with a mark before and after; a shorter one counts whole),
so inflected forms meet; a gram's second and third occurrence in a text are terms of their own.  A bounded sample of
labelled rows (the sample_rows whose ids hash lowest) says which terms tell: those that toxic examples hold min_lift times as
often as others and significantly so (chi-squared of at least min_chi2); however many they are, all are used.  Over these a
document is a TF-IDF vector, with document frequencies over all N documents; the sample's non-zero vectors are the examples.  (The
cosine over all words or grams isn't used, as it can't tell: on the labels of sf0.1 a vote over 0.5 finds 6 % of toxic documents so.)

Each document is a query, its whole text.  Its k nearest examples are exact: examples lie in blocks, each term has a list of
postings for each block that holds it, with the greatest weight there.  A block's bound is the sum of query weight times that maximum;
blocks are opened in the order of their bounds, and once the k-th cosine so far is above a bound that block and those after it are never
read.  A document is never its own neighbour.  The neighbours vote with weight cosine**2; isotonic regression of the examples' labels on
their own leave-one-out votes turns a vote into a probability.  A document that has none of the terms has no neighbour: it gets the
rate of such documents in the sample, and is never called toxic, as nothing speaks for it.

Texts are read three times (selection reads the sample alone) and never shuffled; the driver holds the terms and sparse vectors
of at most sample_rows examples, whatever the corpus is.

Defined results: null and empty texts have no neighbour; very long texts are one vector like any other; ties in cosine (6
places) go to the lower id; repeated rows each get a row; a repeated labelled id counts once (toxic if any label says so, and of
several texts the least); null labels and ids aren't learnt from; a null id is scored; with no toxic example every score is 0; an empty
table gives an empty result; score() doesn't read further columns, and keep() returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import batches, cut, text_rows
from .licenses import document_frequency

GRAMS, TIMES = (5, 7), 3
SAMPLE_ROWS, MIN_CHI2, MIN_LIFT, NEIGHBOURS, BLOCK, THRESHOLD = 20_000, 25.0, 5.0, 15, 64, 0.5
CACHE, OPEN_FIRST = 50_000, 2
BATCH = 1_000  # rows that travel to Python at a time while a model is fitted
SCHEMA = "doc_id long, toxic_score double, is_toxic boolean, vote double, evidence array<struct<doc_id:long,cosine:double,toxic:boolean>>"
_HEAD, _TAIL = tk.U64(0xA24BAED4963EE407), tk.U64(0x9FB21C651E98DF25)


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each character n-gram; documents in order for each length."""
    cps, bounds = tk.codepoints(col)
    word, lower, _ = tk.tables()
    start, end, doc = tk.runs(word[cps], bounds)
    size = end - start
    pre = tk.prefix(lower[cps])
    out = []
    for n in GRAMS:
        many = np.maximum(size + 3 - n, 1)
        if n > GRAMS[0]:
            many = np.where(size + 2 <= GRAMS[0], 0, many)  # the whole word was there already
        w = np.repeat(np.arange(len(start)), many)
        j = np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)
        first = start[w] + j - 1
        h = tk.spans(pre, np.maximum(first, start[w]), np.minimum(first + n, end[w]))
        h[j == 0] ^= _HEAD
        h[j == many[w] - 1] ^= _TAIL
        out.append((h, doc[w]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


class Terms:
    """The selected terms, numbered: (gram, occurrence)."""

    def __init__(self, gram: np.ndarray, times: np.ndarray):
        self.keys = np.unique(gram)
        self.number = np.full((len(self.keys), TIMES), -1, np.int64)
        at = np.searchsorted(self.keys, gram)
        self.number[at, times - 1] = np.arange(len(gram))
        self.size = len(gram)

    def of(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term's number, occurrences of its gram), sorted by document."""
        h, doc = grams(col)
        at = tk.lookup(self.keys, h)
        hit = at >= 0
        width = max(len(self.keys), 1)
        code, n = np.unique(doc[hit] * width + at[hit], return_counts=True)
        d, k = np.divmod(code, width)
        number = self.number[k]
        use = (number >= 0) & (np.arange(TIMES) < n[:, None])
        row, _ = np.nonzero(use)
        return d[row], number[use], n[row]

    def hits(self, col: pa.Array) -> np.ndarray:
        return self.of(col)[1]


def _each(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    n = end - start
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class Index:
    """Examples as unit vectors, in blocks of examples whose weightiest terms are alike; for each term and block that holds it a list of postings and their greatest weight."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        self.ids, self.toxic, self.known = ids, toxic, set(ids.tolist())
        top = np.lexsort((-weights, rows))
        first = top[np.flatnonzero(np.concatenate([[True], np.diff(rows[top]) > 0]))] if len(rows) else top
        lead = np.zeros(len(ids), np.int64)
        lead[rows[first]] = terms[first]
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((ids, lead))] = np.arange(len(ids))
        block = place[rows] // BLOCK
        self.blocks = -(-len(ids) // BLOCK)
        order = np.lexsort((rows, block, terms))
        self.rows, self.weights = rows[order], weights[order]
        t, b = terms[order], block[order]
        head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])])) if len(t) else np.zeros(0, np.int64)
        self.start, self.end = head, np.append(head[1:], len(t)).astype(np.int64) if len(t) else head
        self.block, self.most = b[head], np.maximum.reduceat(self.weights, head) if len(t) else np.zeros(0)
        self.lists = np.searchsorted(t[head], np.arange(n_terms + 1))
        self.opened = self.read = 0  # blocks and postings

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest, cosine above 0, best first; ties by lower id."""
        a, b = self.lists[terms], self.lists[terms + 1]
        lists, weight = _each(a, b), np.repeat(weights, b - a)
        bound = np.bincount(self.block[lists], weights=weight * self.most[lists], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        total, at, wave = int(np.count_nonzero(bound > 0)), 0, OPEN_FIRST
        found, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        while at < total and bound[at] >= least - 1e-6:
            to = min(total, at + wave, int(np.searchsorted(-bound, -(least - 1e-6), side="right")))
            now = np.zeros(self.blocks, bool)
            now[order[at:to]] = True
            mine = np.flatnonzero(now[self.block[lists]])
            post = _each(self.start[lists[mine]], self.end[lists[mine]])
            rows, inv = np.unique(self.rows[post], return_inverse=True)
            part = self.weights[post] * np.repeat(weight[mine], self.end[lists[mine]] - self.start[lists[mine]])
            dots = np.round(np.bincount(inv, weights=part, minlength=len(rows)), 6)
            good = (dots > 0) & (self.ids[rows] != skip if skip is not None else True)
            found, cosines = np.append(found, rows[good]), np.append(cosines, dots[good])
            best = np.lexsort((self.ids[found], -cosines))[:k]
            found, cosines = found[best], cosines[best]
            least = cosines[-1] if len(found) == k else 0.0
            self.opened, self.read = self.opened + to - at, self.read + len(post)
            at, wave = to, wave * 2
        return found, cosines


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (x from, value) of the non-decreasing least-squares fit; each pool is smoothed by half an observation either way."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order], strict=True):
        if pools and pools[-1][3] == xi:
            pools[-1][1] += yi
            pools[-1][2] += 1
        else:
            pools.append([xi, yi, 1.0, xi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2], last[3]]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


class Model:
    def __init__(self, terms: Terms, idf: np.ndarray, k: int):
        self.terms, self.idf, self.k = terms, idf, k
        self.index: Index | None = None
        self.steps, self.none = (np.zeros(0), np.zeros(0)), 0.0
        self.cache: dict = {}

    def vectors(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        d, t, n = self.terms.of(col)
        w = n * self.idf[t]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])), len(d)).tolist() if len(d) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(d[a]), t[a:b], w[a:b] / np.sqrt(w[a:b] @ w[a:b])

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int | None) -> tuple[float | None, np.ndarray, np.ndarray]:
        """(vote, neighbours, cosines); results for equal vectors are kept a while."""
        if skip not in self.index.known:
            skip = None
        key = (terms.tobytes(), weights.tobytes(), skip)
        if key not in self.cache:
            rows, cos = self.index.nearest(terms, weights, self.k, skip)
            w = cos**2
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[key] = (float((w * self.index.toxic[rows]).sum() / w.sum()) if len(rows) else None), rows, cos
        return self.cache[key]

    def calibrated(self, vote: float | None) -> float:
        if vote is None or not len(self.steps[0]):
            return self.none
        return float(self.steps[1][max(0, np.searchsorted(self.steps[0], vote, side="right") - 1)])

    def score(self, ids: pa.Array, col: pa.Array) -> tuple[list, list, pa.Array]:
        """(score, vote, evidence) by row."""
        n = len(col)
        score, votes, size = [self.none] * n, [None] * n, np.zeros(n, np.int64)
        rows, cos = [np.zeros(0, np.int64)], [np.zeros(0)]
        if self.index is not None:
            names = ids.to_pylist()
            for d, t, w in self.vectors(col):
                v, r, c = self.vote(t, w, names[d])
                score[d], votes[d], size[d] = self.calibrated(v), v, len(r)
                rows.append(r)
                cos.append(c)
        at, cosine = np.concatenate(rows), np.concatenate(cos)
        named = (self.index.ids[at], self.index.toxic[at]) if self.index is not None else (at, at.astype(bool))
        struct = pa.StructArray.from_arrays([pa.array(named[0], pa.int64()), pa.array(cosine), pa.array(named[1], pa.bool_())], ["doc_id", "cosine", "toxic"])
        return score, votes, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), struct)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, occurrence, toxic documents, others) over the task's labelled rows (text, toxic)."""
    for batch in batches:
        for part in tk.slices(batch, 0, tk.SMALL_SLICE):
            h, doc = grams(part.column(0))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(head, len(h)))
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for times in range(1, TIMES + 1):
                at = head[n >= times]
                uniq, inv = np.unique(h[at], return_inverse=True)
                t = np.bincount(inv, weights=toxic[doc[at]], minlength=len(uniq)).astype(np.int64)
                o = np.bincount(inv, minlength=len(uniq)) - t
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.full(len(uniq), times), pa.int32()), pa.array(t), pa.array(o)], ["gram", "times", "toxic_n", "other_n"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most rows labelled documents, those whose ids hash lowest, each once."""
    pick = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    pick = pick.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = text_rows(docs).where("text IS NOT NULL").join(F.broadcast(pick), "doc_id")  # at most rows
    return cut(joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, min_chi2: float = MIN_CHI2, min_lift: float = MIN_LIFT, k: int = NEIGHBOURS) -> Model:
    """The frozen model: selected terms, their idf over all docs, the examples' index, and the calibration."""
    with batches(docs.sparkSession, BATCH):
        return _fit(docs, labels, label_col, sample_rows, min_chi2, min_lift, k)


def _fit(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int, min_chi2: float, min_lift: float, k: int) -> Model:
    sample = labelled_sample(docs, labels, label_col, sample_rows)
    size = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(True, 0), size.get(False, 0)
    model = Model(Terms(np.zeros(0, tk.U64), np.zeros(0, np.int64)), np.zeros(0), k)
    if not pos:
        return model
    seen = sample.select("text", "toxic").mapInArrow(_gram_counts, "gram long, times int, toxic_n long, other_n long").groupBy("gram", "times").agg(F.sum("toxic_n").cast("double").alias("a"), F.sum("other_n").cast("double").alias("b"))
    total, hit = float(pos + neg), F.col("a") + F.col("b")
    chi2 = total * F.pow(F.col("a") * (neg - F.col("b")) - F.col("b") * (pos - F.col("a")), F.lit(2)) / F.greatest(F.lit(1.0), hit * (total - hit) * pos * neg)
    telling = (F.col("a") > 0) & (F.col("a") * max(neg, 1) >= F.col("b") * pos * min_lift)
    chosen = seen.where(telling).withColumn("chi2", chi2).where((F.col("chi2") >= min_chi2) if neg else F.lit(True)).orderBy(F.desc("chi2"), "gram", "times").toArrow()
    model.terms = Terms(chosen["gram"].to_numpy().astype(np.int64).view(tk.U64), chosen["times"].to_numpy().astype(np.int64))
    df = document_frequency(text_rows(docs).select("text"), model.terms.size, model.terms.hits, tk.SMALL_SLICE)
    model.idf = np.log((1 + docs.count()) / (1 + df)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, 1, tk.SMALL_SLICE):
                got = list(model.vectors(part.column(1)))
                at = pa.array([d for d, _, _ in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(2).take(at), pa.array([t for _, t, _ in got], pa.list_(pa.int64())), pa.array([w for _, _, w in got], pa.list_(pa.float64()))],
                    ["doc_id", "toxic", "terms", "weights"],
                )

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id long, toxic boolean, terms array<long>, weights array<double>").toArrow().sort_by("doc_id")
    met = int(np.sum(rows["toxic"].to_numpy(zero_copy_only=False).astype(bool)))
    model.none = (pos - met + 0.5) / (pos + neg - rows.num_rows + 1)
    if rows.num_rows:
        terms, weights = rows["terms"].to_pylist(), rows["weights"].to_pylist()
        each = np.repeat(np.arange(rows.num_rows), [len(t) for t in terms])
        toxic = rows["toxic"].to_numpy(zero_copy_only=False).astype(bool)
        model.index = Index(rows["doc_id"].to_numpy(), toxic, each, np.concatenate(terms).astype(np.int64), np.concatenate(weights), model.terms.size)
        votes = [model.vote(np.array(t), np.array(w), int(i))[0] for i, t, w in zip(model.index.ids, terms, weights, strict=True)]
        some = np.array([v is not None for v in votes])
        model.steps = isotonic(np.array([v for v in votes if v is not None]), toxic[some].astype(float))
        model.cache = {}  # the model goes to every worker
    return model


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, toxic_score, is_toxic (score at least threshold, and some neighbour), vote (null: no neighbour) and evidence for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, 1, tk.SMALL_SLICE):
                p, votes, evidence = shared.value.score(part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array([x >= threshold and v is not None for x, v in zip(p, votes, strict=True)], pa.bool_()), pa.array(votes, pa.float64()), evidence], ["doc_id", "toxic_score", "is_toxic", "vote", "evidence"])

    return text_rows(docs).mapInArrow(work, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    at, name = docs.columns.index("text"), docs.columns.index("doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, at, tk.SMALL_SLICE):
                p, votes, _ = shared.value.score(part.column(name), part.column(at))
                yield part.filter(pa.array([x < threshold or v is None for x, v in zip(p, votes, strict=True)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
