"""Operator 7, packing: related documents beside each other in fixed windows.

1. Nodes are the distinct texts (sequences of lower-cased words); each is a TF-IDF vector over its words, which are hashed to
   2**FEATURES numbers (tf * (ln((1+N) / (1+df)) + 1), df over all N rows), and then a point of DIMS dimensions: the leading
   directions of a bounded sample of SAMPLE vectors, each scaled by the fourth root of its share, so that what all texts of a language
   have in common doesn't drown the rest.  Similarity is the cosine of two points.
2. Every node is linked to its NEIGHBOURS nearest, whatever their cosine (6 places; ties: lower node).  They are looked for in a forest of TREES
   random-projection trees: the upper splits are fitted on a bounded sample of points and route every point to a cell; in
   the task of a cell the splits go on at the median, down to LEAF points, all of which are compared.  So every row is
   indexed, the work is in proportion to the rows, and no cell is hot (equal points are split too).  Recall against brute force is measured
   in the tests and in the README (at least 0.9).
3. The nodes of about SHARD points of the first tree are walked greedily along their links: a path starts at the node of
   least degree that is left (ties: lower node) and goes on to the nearest neighbour not yet visited (ties: lower degree, then lower node) until
   there is none.
4. The links that leave a shard then have their turn, all of them: steps and leaving links are gone through, best first, and each is kept whose
   nodes both have fewer than two so far, so a leaving link takes the place of a worse step.  A node whose step gave way looks at its other links inside
   the shard in the same manner.  A ring that comes of this opens at its worst joining link.  A joined path begins with that of its two outer stretches
   whose first node is lower and lies in its shard.  The result is that of going through the links one by one (settle()), in rounds over
   the whole table; what AT_ONCE links are left with is done in one task, and with one shard the walk stays as it is.
5. A shard's paths, one after the other, fill windows of WINDOW words, so only a shard's last window is short, and a document
   that a window can't hold goes on in the next.  Of each node the row with the least id is placed in its path; further copies, and rows
   without a word, aren't worth a context together: they are dealt to all shards by a hash, after the paths.

Texts are read three times and never shuffled.  The driver holds the counts of the 2**FEATURES numbers, SAMPLE vectors and
FIT points, whatever the corpus is.

The result has a row for each piece: window_id, slot (place in the window), doc_id, path (shard and number of the path there, or "copies"),
from_word and to_word (half open).

Defined results: null and empty texts and texts without a word have one empty piece; very long texts go on over as many windows as they
need; a null id is placed like any other (after the ids of its copies); rows that repeat an id are pieces of their own; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import batches, cut, text_rows
from .graph import components

FEATURES, SAMPLE, DIMS, NEIGHBOURS = 18, 2_000, 24, 4
TREES, LEAF, CELL, MOST_CELLS, FIT = 8, 512, 16_384, 4_096, 131_072
SHARD, WINDOW, AT_ONCE = 8_192, 2_048, 262_144
BATCH, SLICE = 1_000, 1 << 20  # rows that travel to Python at a time, and bytes of text that it works on at a time
NODES = "doc_id long, key long, words long, node long, features array<int>, times array<long>"
WALKED = "node long, shard long, place long, prev long, far double, steps int, out array<struct<far:double,node:long>>, inside array<struct<far:double,node:long,steps:int>>"


def _counts(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, occurrences) sorted by both; words of each document, and a hash of their sequence."""
    h, _, _, doc = tk.words(*tk.codepoints(col))
    words = np.bincount(doc, minlength=len(col))
    upto = np.concatenate([[0], np.cumsum(words)])
    node = tk.spans(tk.prefix(h), upto[:-1], upto[1:]).view(np.int64)
    code = np.sort(doc.astype(np.int64) << FEATURES | (h >> tk.U64(64 - FEATURES)).astype(np.int64))
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[head] >> FEATURES, code[head] & ((1 << FEATURES) - 1), np.diff(np.append(head, len(code))), words, node


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, key: hash of the text, words, node: null without a word) of every row of docs; also a row of words -1 for each task with its document frequencies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in NODES.split(", ")]
        df, any_ = np.zeros(1 << FEATURES, np.int64), False
        for batch in batches:
            for part in tk.slices(batch, 1, SLICE):
                _, feature, _, words, node = _counts(part.column(1))
                df += np.bincount(feature, minlength=len(df))
                any_ = True
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(words, pa.int64()), pa.array(node, mask=words == 0), pa.nulls(part.num_rows, pa.list_(pa.int32())), pa.nulls(part.num_rows, pa.list_(pa.int64()))], names)
        if any_:
            some = np.flatnonzero(df)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([-1], pa.int64()), none, pa.array([some], pa.list_(pa.int32())), pa.array([df[some]], pa.list_(pa.int64()))], names)

    return text_rows(docs).withColumn("key", F.xxhash64("text")).mapInArrow(work, NODES)


def vectors(col: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, weight) of the unit vectors; hash of each document's words."""
    doc, feature, n, _, node = _counts(col)
    w = n * idf[feature]
    return doc, feature, w / np.sqrt(np.bincount(doc, weights=w * w, minlength=len(col)))[doc], node


def _leading(gram: np.ndarray, k: int, turns: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues and their vectors, by subspace iteration, which takes little memory besides the matrix."""
    n, b = len(gram), 2 * k + 16
    if n <= 8 * b:
        value, vector = np.linalg.eigh(gram.astype(np.float64))
        return value[::-1][:k], vector[:, ::-1][:, :k]
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((n, b)).astype(np.float32))[0]
    for _ in range(turns):
        q = np.linalg.qr(gram @ q)[0]
    value, vector = np.linalg.eigh((q.T @ (gram @ q)).astype(np.float64))
    return value[::-1][:k], q.astype(np.float64) @ vector[:, ::-1][:, :k]


def directions(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, rows: int, dims: int) -> np.ndarray:
    """[feature, dimension]: the leading right singular vectors of the sample's matrix, each divided by the square root of its singular value."""
    order = np.argsort(feature, kind="stable")
    row, feature, weight = row[order], feature[order], weight[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])) if len(feature) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(feature)))
    gram = np.zeros((rows, rows), np.float32)
    for n in range(1, 17):  # features that few vectors share: pair by pair
        at = first[many == n]
        for i in range(n):
            for j in range(n):
                np.add.at(gram, (row[at + i], row[at + j]), weight[at + i] * weight[at + j])
    often = np.flatnonzero(many > 16)
    for a in range(0, len(often), 2_048):
        own = often[a : a + 2_048]
        at = np.repeat(first[own] - (np.cumsum(many[own]) - many[own]), many[own]) + np.arange(int(many[own].sum()))
        x = np.zeros((rows, len(own)), np.float32)
        x[row[at], np.repeat(np.arange(len(own)), many[own])] = weight[at]
        gram += x @ x.T
    out = np.zeros((1 << FEATURES, dims), np.float32)
    if not rows:
        return out
    value, vector = _leading(gram, dims)
    del gram
    good = value > 1e-5 * max(value[0], 1e-30)  # what is below is rounding
    vector = np.where(good, vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])]) / np.where(good, value, 1.0) ** 0.75, 0.0)
    for k in range(vector.shape[1]):  # one after the other, as all at once would take the sample's size times dims
        out[feature[first], k] = np.add.reduceat(weight * vector[row, k], first)
    return out


def points(col: pa.Array, idf: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents that have a word, their nodes, their unit points)."""
    doc, feature, w, node = vectors(col, idf)
    if not len(doc):
        return doc, node[:0], np.zeros((0, to.shape[1]), np.float32)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    x = np.add.reduceat(w[:, None].astype(np.float32) * to[feature], first)
    return doc[first], node[doc[first]], (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)


def _jitter(node: np.ndarray, salt: int) -> np.ndarray:
    """A number below 1e-6 for each node, so that equal points have an order."""
    return (tk.mix(node.view(tk.U64) ^ tk.mix(np.array([salt], tk.U64))) >> tk.U64(40)).astype(np.float64) * (1e-6 / (1 << 24))


def fit_tree(x: np.ndarray, node: np.ndarray, cells: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(normal, threshold) of each inner node of a balanced tree of so many cells, in heap order: normals from two random points, thresholds at the median."""
    rnd = np.random.default_rng(tree)
    normal, at = np.zeros((max(cells - 1, 0), x.shape[1]), np.float32), np.zeros(max(cells - 1, 0))
    here: list = [np.arange(len(x))]
    for i in range(cells - 1):
        own = here[i]
        if len(own) >= 2:
            a, b = rnd.choice(len(own), 2, replace=False)
            normal[i] = x[own[a]] - x[own[b]]
        y = x[own] @ normal[i] + _jitter(node[own], i)
        at[i] = np.median(y) if len(y) else 0.0
        left = y < at[i]
        here += [own[left], own[~left]]
    return normal, at


def route(x: np.ndarray, node: np.ndarray, normal: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    cells = len(at) + 1
    i = np.zeros(len(x), np.int64)
    for _ in range(cells.bit_length() - 1):
        salt = tk.mix(i.view(tk.U64))  # as _jitter() does for one inner node
        y = np.einsum("ij,ij->i", x, normal[i]) + (tk.mix(node.view(tk.U64) ^ salt) >> tk.U64(40)).astype(np.float64) * (1e-6 / (1 << 24))
        i = 2 * i + 1 + (y >= at[i])
    return i - (cells - 1)


def leaves(x: np.ndarray, node: np.ndarray, leaf: int, seed: int, shard: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """(members, number of the part of at most shard points it is from) of each leaf of a tree that is split at the median down to leaf points."""
    rnd, part = np.random.default_rng(seed), -1
    stack = [(np.arange(len(x)), False)]
    while stack:
        own, inside = stack.pop()
        if not inside and len(own) <= max(shard, leaf):
            part, inside = part + 1, True
        if len(own) <= leaf:
            yield own, part
            continue
        a, b = rnd.choice(len(own), 2, replace=False)
        order = np.argsort(x[own] @ (x[own[a]] - x[own[b]]) + _jitter(node[own], len(own)), kind="stable")
        stack += [(own[order[len(own) // 2 :]], inside), (own[order[: len(own) // 2]], inside)]  # parts come one after the other


def nearest(x: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """[point, place]: the k nearest of all others (their nodes; cosines of 6 places, -2 where there are fewer), ties by lower node."""
    k_ = min(k, len(x) - 1)
    out, cosine = np.zeros((len(x), k), np.int64), np.full((len(x), k), -2.0)
    if k_ < 1:
        return out, cosine
    order = np.argsort(node)
    cos = (x @ x[order].T).astype(np.float64)
    rank = np.rint(cos * 1e6).astype(np.int64)
    rank[order, np.arange(len(x))] = -(2 << 40)
    rank = rank * len(x) - np.arange(len(x))  # ties go to the lower node
    top = np.argpartition(-rank, k_ - 1, axis=1)[:, :k_]
    value = np.take_along_axis(rank, top, 1)
    by = np.argsort(-value, axis=1)
    top, value = np.take_along_axis(top, by, 1), np.take_along_axis(value, by, 1)
    out[:, :k_], cosine[:, :k_] = node[order[top]], -(-value // len(x)) / 1e6
    return out, cosine


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, cell, node, point), those of a tree's cell together: (node, near: [(cosine below 1, neighbour)], shard: of at most so many points of the first tree)."""
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        node, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        node, first = np.unique(node, return_index=True)
        x = x[first]
        tree, cell = now
        for own, part in leaves(x, node, LEAF, tree, 0 if tree else most):
            other, cos = nearest(x[own], node[own], NEIGHBOURS)
            some = cos > -1.5
            offsets = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(-cos[some]), pa.array(other[some])], ["far", "node"]))
            shard = pa.nulls(len(own), pa.int64()) if tree else pa.array(np.full(len(own), (cell << 32) + part, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), near, shard], ["node", "near", "shard"])

    for batch in batches:
        tree, cell, node = (batch.column(i).to_numpy() for i in range(3))
        raw = batch.column(3)
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset :][: batch.num_rows + 1]
        x = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.float32).reshape(batch.num_rows, -1)
        cuts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (cell[1:] != cell[:-1])])).tolist() + [batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = (int(tree[a]), int(cell[a]))
            if at != now and held:
                yield from flush()
                held = []
            now = at
            held.append((node[a:b], x[a:b]))
    if held:
        yield from flush()


def embed(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, point) of the rows of docs that have a word, those that a task meets again left out; signed: nodes(docs)."""
    counted = signed.where("words < 0").select(F.explode(F.arrays_zip("features", "times")).alias("x")).groupBy("x.features").agg(F.sum("x.times").alias("n")).toArrow()
    total = signed.where("words >= 0").count()
    df = np.zeros(1 << FEATURES, np.int64)
    df[counted["features"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    pick = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")).orderBy("node").limit(SAMPLE).toArrow()  # a node is a hash, so this is a random sample
    own = np.sort(pick["node"].to_numpy())

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, 0, SLICE):
                doc, feature, w, node = vectors(part.column(0), idf)
                mine = np.isin(node[doc], own)  # an id may have other texts
                doc, feature, w = doc[mine], feature[mine], w[mine]
                yield pa.RecordBatch.from_arrays([pa.array(node[doc]), pa.array(feature, pa.int32()), pa.array(w)], ["node", "feature", "weight"])

    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pick["doc_id"].cast(pa.int64())}).to_pandas() if pick.num_rows else [], "doc_id long").distinct()
    few = text_rows(docs).join(F.broadcast(ids), "doc_id").select("text").mapInArrow(drawn, "node long, feature int, weight double").distinct().toArrow()  # pick has SAMPLE rows at most
    _, row = np.unique(few["node"].to_numpy(), return_inverse=True)
    feature, weight = few["feature"].to_numpy(), few["weight"].to_numpy()
    del few
    to = directions(row.astype(np.int32), feature, weight, int(row.max()) + 1 if len(row) else 0, DIMS)
    shared = docs.sparkSession.sparkContext.broadcast((idf, to))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in tk.slices(batch, 0, SLICE):
                _, node, x = points(part.column(0), *shared.value)
                new = np.array([not (v in seen or seen.add(v)) for v in node.tolist()], bool)
                raw = pa.Array.from_buffers(pa.binary(), int(new.sum()), [None, pa.py_buffer((np.arange(new.sum() + 1) * 4 * DIMS).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x[new]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), raw], ["node", "point"])

    return text_rows(docs).select("text").mapInArrow(work, "node long, point binary")


def graph(placed: DataFrame, total: int, k: int = NEIGHBOURS, shard: int = SHARD) -> DataFrame:
    """(node, near: the k nearest found as [(far: minus the cosine, node)], shard) of each node of placed (node, point), of which there are about total."""
    cells = 1
    while cells * CELL < total and cells < MOST_CELLS:
        cells *= 2
    drawn = placed.orderBy("node").limit(min(FIT, 32 * cells)).toArrow() if cells > 1 else placed.limit(0).toArrow()
    x = np.frombuffer(b"".join(drawn["point"].to_pylist()), np.float32).reshape(-1, DIMS)
    trees = placed.sparkSession.sparkContext.broadcast([fit_tree(x, drawn["node"].to_numpy(), cells, t) for t in range(TREES)])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, DIMS)
            for t, tree in enumerate(trees.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), pa.array(route(x, node, *tree), pa.int32()), batch.column(0), batch.column(1)], ["tree", "cell", "node", "point"])

    dealt = placed.mapInArrow(routed, "tree int, cell int, node long, point binary")
    parts = max(1, TREES * cells)
    found = dealt.repartitionById(parts, F.col("tree") * cells + F.col("cell")).sortWithinPartitions("tree", "cell").mapInArrow(lambda batches: _forest(batches, shard), "node long, near array<struct<far:double,node:long>>, shard long")
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)  # TREES lists of k each
    return found.groupBy("node").agg(best.alias("near"), F.max("shard").alias("shard"))


def walk(edges: list[tuple[int, int, float]], alone: list[int] = ()) -> list[tuple[int, int]]:
    """(path, node) in the order of the walk over the edges (a, b, similarity); alone: nodes that may have none."""
    around: dict[int, list[tuple[int, float]]] = {v: [] for v in alone}
    for a, b, s in edges:
        around.setdefault(a, []).append((b, s))
        around.setdefault(b, []).append((a, s))
    degree = {v: len(x) for v, x in around.items()}
    for x in around.values():
        x.sort(key=lambda e: (-e[1], degree[e[0]], e[0]))
    heap = [(d, v) for v, d in degree.items()]
    heapify(heap)
    seen: set[int] = set()
    out, path = [], -1
    while heap:
        _, v = heappop(heap)
        if v in seen:
            continue
        path += 1
        while v is not None:
            seen.add(v)
            out.append((path, v))
            v = next((u for u, _ in around[v] if u not in seen), None)
    return out


def _lists(rows: list[list[tuple]], names: list[str], types: list[pa.DataType]) -> pa.Array:
    """A list of structs for each row."""
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array([x[i] for row in rows for x in row], t) for i, t in enumerate(types)], names))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, near), those of a shard together: WALKED of the walk over the links inside the shard."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        names, edges, out, inside = {v for v, _ in held}, {}, {}, {}
        for v, near in held:
            for e in near or ():
                if e["node"] in names:
                    at = (min(v, e["node"]), max(v, e["node"]))
                    edges[at] = max(edges.get(at, -2.0), -e["far"])
                else:
                    out.setdefault(v, []).append((e["far"], e["node"]))
        got = walk([(a, b, s) for (a, b), s in edges.items()], sorted(names))
        before = [None] + [v if p == q else None for (p, v), (q, _) in zip(got[:-1], got[1:], strict=True)]
        far = [None if u is None else -edges.pop((min(u, v), max(u, v))) for u, (_, v) in zip(before, got, strict=True)]
        own = [v for _, v in got]
        steps = [(u is not None) + (w is not None) for u, w in zip(before, before[1:] + [None], strict=True)]
        many = dict(zip(own, steps, strict=True))
        for (a, b), s in edges.items():  # those that weren't walked
            inside.setdefault(a, []).append((-s, b, many[b]))
            inside.setdefault(b, []).append((-s, a, many[a]))
        columns = [pa.array(own, pa.int64()), pa.array([now] * len(got), pa.int64()), pa.array(range(len(got)), pa.int64()), pa.array(before, pa.int64()), pa.array(far, pa.float64()), pa.array(steps, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, _lists([out.get(v, []) for v in own], ["far", "node"], [pa.float64(), pa.int64()]), _lists([inside.get(v, []) for v in own], ["far", "node", "steps"], [pa.float64(), pa.int64(), pa.int32()])], [f.split()[0] for f in WALKED.split(", ")])

    for batch in batches:
        for shard, node, near in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if shard != now and held:
                yield flush()
                held = []
            now = shard
            held.append((node, near))
    if held:
        yield flush()


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """settle() of all rows (lo, hi, far, later, v, cap), each link once for either of its nodes v, one link after the other."""
    rows = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], pa.schema([(x, pa.float64() if x == "far" else pa.int64()) for x in ("lo", "hi", "far", "later", "v", "cap")]))])
    lo, hi, far, v = (rows[x].to_numpy() for x in ("lo", "hi", "far", "v"))
    node, first = np.unique(v, return_index=True)
    cap = rows["cap"].to_numpy()[first].tolist()
    own = np.flatnonzero(v == lo)
    own = own[np.lexsort((hi[own], lo[own], far[own]))]
    taken = []
    for a, b in zip(np.searchsorted(node, lo[own]).tolist(), np.searchsorted(node, hi[own]).tolist(), strict=True):
        taken.append(cap[a] > 0 and cap[b] > 0)
        cap[a] -= taken[-1]
        cap[b] -= taken[-1]
    rows = rows.select(["lo", "hi", "far", "later"]).take(pa.array(own)).append_column("taken", pa.array(taken, pa.bool_()))
    yield from rows.to_batches(10_000)


def settle(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(lo, hi, far, later, taken) of each of edges (lo, hi, far, later, cap_lo, cap_hi): taken as if one went through them, best first (ties: lower
    nodes), and took each whose nodes have both taken fewer than their cap.  Each round takes the links that are among the best of both their nodes, which is
    what going through them would take, as no better one is left there; the last at_once links are gone through in one task."""
    now, left, out = edges.withColumn("taken", F.lit(False)), edges.count(), []
    by = W.partitionBy("v")
    good = F.row_number().over(by.orderBy("far", "lo", "hi")) <= F.col("cap")
    while left or not out:
        both = now.select("*", F.explode(F.array("lo", "hi")).alias("v")).withColumn("cap", F.when(F.col("v") == F.col("lo"), F.col("cap_lo")).otherwise(F.col("cap_hi")))
        if out:
            both = both.withColumn("cap", F.col("cap") - F.sum(F.col("taken").cast("int")).over(by)).where("NOT taken")
        if left <= at_once:
            out.append(both.select("lo", "hi", "far", "later", "v", "cap").coalesce(1).mapInArrow(_in_order, "lo long, hi long, far double, later long, taken boolean"))
            break
        sides = [F.min(F.when(F.col("v") == F.col(x), F.col("cap"))).alias(f"cap_{x}") for x in ("lo", "hi")]
        now = cut(both.withColumn("good", good).groupBy("lo", "hi", "far", "later").agg(*sides, F.min("good").alias("taken")).withColumn("gone", F.least("cap_lo", "cap_hi") <= 0))
        out.append(now.where("taken OR gone").select("lo", "hi", "far", "later", "taken"))
        now = now.where("NOT gone").drop("gone")
        left = now.where("NOT taken").count()
    return cut(reduce(DataFrame.union, out))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, lo, hi, far, head_lo, head_hi), those of a component together: (head, start: head of the chain's first, nth, back: whether
    it is run from its end) of each stretch that a link joins to others."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        around: dict[int, list[tuple[tuple, int, int]]] = {}
        for far, lo, hi, a, b in held:
            around.setdefault(a, []).append(((far, lo, hi), lo, b))  # link, own node, other stretch
            around.setdefault(b, []).append(((far, lo, hi), hi, a))
        seen, gone, out = set(), set(), []
        for first in sorted(around):
            if first in seen:
                continue
            todo, all_ = [first], {first}
            while todo:
                for _, _, u in around[todo.pop()]:
                    if u not in all_:
                        all_.add(u)
                        todo.append(u)
            some = [link for v in all_ for link, _, _ in around[v]]
            if len(some) == 2 * len(all_):  # a ring
                gone.add(max(some))
            seen |= all_
            v = min(v for v in all_ if sum(link not in gone for link, _, _ in around[v]) == 1)
            start, come, nth = v, None, 0
            while v is not None:
                go = next((x for x in around[v] if x[0] not in gone and x[0] != come), None)
                if come is None:
                    back = go[1] == v
                else:
                    back = next(own for link, own, _ in around[v] if link == come) != v
                out.append((v, start, nth, back))
                v, come, nth = (go[2], go[0], nth + 1) if go else (None, None, 0)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.bool_()])], ["head", "start", "nth", "back"])

    for batch in batches:
        for component, *link in zip(*(batch.column(i).to_pylist() for i in (0, 3, 1, 2, 4, 5)), strict=True):
            if component != now and held:
                yield flush()
                held = []
            now = component
            held.append(tuple(link))
    if held:
        yield flush()


def across(walked: DataFrame, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame] | None:
    """(later node of the steps of walked that give way, links that are walked besides: (lo, hi, far)); None where no link leaves its shard."""
    undirected = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    ends = lambda d: d.select(F.explode(F.array("lo", "hi")).alias("node"))
    no_step, full = F.lit(None).cast("long").alias("later"), [F.lit(2).alias("cap_lo"), F.lit(2).alias("cap_hi")]
    leaving = walked.select(F.col("node").alias("a"), F.explode("out").alias("x")).select("a", F.col("x.node").alias("b"), "x.far")
    leaving = cut(leaving.groupBy(*undirected).agg(F.min("far").alias("far")))
    many = leaving.count()
    if not many:
        return None
    sent = F.broadcast if many <= at_once else lambda d: d  # for tables of no more than a few rows a link
    # steps between nodes without such a link stay
    met = ends(leaving).distinct().withColumn("met", F.lit(True))
    steps = walked.where("prev IS NOT NULL").select("node", "prev", "far").join(sent(met), "node", "left").join(sent(met.select(F.col("node").alias("prev"), F.col("met").alias("met_"))), "prev", "left").where("met OR met_")
    steps = steps.select(F.least("node", "prev").alias("lo"), F.greatest("node", "prev").alias("hi"), "far", F.col("node").alias("later"), *full)
    settled = settle(cut(steps.union(leaving.select("lo", "hi", "far", no_step, *full))), at_once)
    lost, joins = settled.where("later IS NOT NULL AND NOT taken"), settled.where("later IS NULL AND taken").select("lo", "hi", "far")
    # the nodes whose step gave way look at their other links inside the shard again
    more = ends(lost).withColumn("n", F.lit(1)).union(ends(joins).withColumn("n", F.lit(-1))).groupBy("node").agg(F.sum("n").cast("int").alias("n"), F.max("n").alias("freed"))
    again = walked.join(sent(more.where("freed = 1").select("node")), "node", "left_semi").select(F.col("node").alias("a"), "steps", F.explode("inside").alias("x"))
    again = again.select("a", F.col("x.node").alias("b"), "x.far", F.col("steps").alias("steps_a"), F.col("x.steps").alias("steps_b"))
    own = [F.when(F.col("a") == F.expr(f"{f}(a, b)"), F.col("steps_a")).otherwise(F.col("steps_b")).alias(f"steps_{x}") for x, f in (("lo", "least"), ("hi", "greatest"))]
    again = again.select(*undirected, "far", *own).distinct()
    for x in ("lo", "hi"):
        again = again.join(sent(more.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))), x, "left").withColumn(f"cap_{x}", 2 - F.col(f"steps_{x}") + F.coalesce(f"n_{x}", F.lit(0)))
    again = settle(cut(again.where("cap_lo > 0 AND cap_hi > 0").select("lo", "hi", "far", no_step, "cap_lo", "cap_hi")), at_once)
    return lost.select(F.col("later").alias("node")), joins.union(again.where("taken").select("lo", "hi", "far"))


def ordered(walked: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, shard, home, nth, way) of the rows of walked (WALKED): in a shard, paths have different homes, and the nodes of a path are in the order of nth and way."""
    changed = across(walked, at_once)
    begins = F.col("prev").isNull()
    rows = walked.select("node", "shard", "place", "prev")
    if changed:
        lost, joins = changed
        many = joins.count()
        sent = F.broadcast if max(many, lost.count()) <= at_once else lambda d: d
        rows = rows.join(sent(lost.withColumn("lost", F.lit(True))), "node", "left")
        begins |= F.col("lost").isNotNull()
    upto = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = cut(rows.select("node", "shard", "place", *(F.last(F.when(begins, F.col(a)), ignorenulls=True).over(upto).alias(b) for a, b in (("node", "head"), ("place", "home")))))
    if not changed:
        return rows.select("node", "shard", "home", F.lit(0).cast("long").alias("nth"), F.col("place").alias("way"))
    for x in ("lo", "hi"):
        joins = rows.select(F.col("node").alias(x), F.col("head").alias(f"head_{x}")).join(sent(joins), x)
    joins = joins.where("head_lo <> head_hi")  # a stretch isn't joined to itself
    if many <= at_once:
        together = joins.select(F.lit(0).cast("long").alias("component"), "lo", "hi", "far", "head_lo", "head_hi").repartition(1)
    else:
        joins = cut(joins)
        found = components(joins.select(F.col("head_lo").alias("a"), F.col("head_hi").alias("b")))
        together = joins.join(found.withColumnRenamed("id", "head_lo"), "head_lo").select("component", "lo", "hi", "far", "head_lo", "head_hi").repartition("component").sortWithinPartitions("component")
    chains = together.mapInArrow(_chains, "head long, start long, nth long, back boolean")
    chains = rows.where("node = head").select(F.col("node").alias("start"), F.col("shard").alias("to"), F.col("home").alias("at")).join(sent(chains), "start").drop("start")
    rows = rows.join(sent(chains), "head", "left")
    return cut(rows.select("node", F.coalesce("to", "shard").alias("shard"), F.coalesce("at", "home").alias("home"), F.coalesce("nth", F.lit(0).cast("long")).alias("nth"), F.when(F.col("back"), -F.col("place")).otherwise(F.col("place")).alias("way")))


def links(docs: DataFrame, signed: DataFrame | None = None, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(graph() of docs, nodes(docs))."""
    signed = cut(nodes(docs)) if signed is None else signed
    placed = cut(embed(docs, signed))
    return cut(graph(placed, placed.count(), shard=shard)), signed


def pack(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, at_once: int = AT_ONCE) -> DataFrame:
    """window_id, slot, doc_id, path, from_word, to_word: the pieces of all rows of docs (doc_id, text)."""
    with batches(docs.sparkSession, BATCH):
        linked, signed = links(docs, shard=shard)
        order = ordered(cut(linked.select("shard", "node", "near").repartition("shard").sortWithinPartitions("shard").mapInArrow(_walks, WALKED)), at_once)
    # shards as 0, 1, ...: their number is the documents' by SHARD
    numbers = cut(order.select("shard").distinct().withColumn("number", F.row_number().over(W.orderBy("shard")) - 1))
    shards = max(1, numbers.count())
    rows = signed.where("words >= 0").select("doc_id", "key", "words", "node").withColumn("tie", F.monotonically_increasing_id())
    rows = cut(rows)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "tie", "words")
    heads = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(first).alias("head")).join(order, "node").join(numbers, "shard")
    heads = heads.select("head.doc_id", "head.words", F.col("head.tie").alias("tie"), F.col("number").cast("long").alias("shard"), "home", "nth", "way")
    rest = rows.join(heads.select("tie"), "tie", "left_anti").select("doc_id", "words", "tie", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards).cast("long")).alias("shard"), *(F.lit(None).cast("long").alias(c) for c in ("home", "nth", "way")))
    placed = heads.union(rest)
    placed = placed.withColumn("path", F.when(F.col("home").isNotNull(), F.dense_rank().over(W.partitionBy("shard").orderBy(F.asc_nulls_last("home"))) - 1))
    sequence = [F.asc_nulls_last("home"), "nth", "way", "doc_id", "tie"]
    run = placed.withColumn("end", F.sum("words").over(W.partitionBy("shard").orderBy(*sequence).rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("start", F.col("end") - F.col("words"))
    begin, last = F.floor(F.col("start") / window), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / window)
    piece = run.withColumn("w", F.explode(F.sequence(begin, last)))
    piece = piece.withColumn("from_word", F.greatest(F.col("w") * window - F.col("start"), F.lit(0).cast("long"))).withColumn("to_word", F.least((F.col("w") + 1) * window - F.col("start"), F.col("words")))
    piece = piece.withColumn("window_id", F.col("shard") * F.lit(1 << 32) + F.col("w"))
    slot = F.row_number().over(W.partitionBy("shard", "w").orderBy("start", *sequence))
    return piece.select("window_id", slot.alias("slot"), "doc_id", F.concat_ws("/", F.col("shard").cast("string"), F.coalesce(F.col("path").cast("string"), F.lit("copies"))).alias("path"), "from_word", "to_word")
