"""Operator 1, license scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Terms are lower-cased runs of letters and numbers.  A term weighs tf * (ln((1+N) / (1+df)) + 1) with df over all N texts;
the counts are taken for the templates' terms, and any other term weighs as if no text had it, so foreign words only lower
a cosine.  Headers are compared with NOTICES: every run of one to LINES lines, and every paragraph (lines up to one without a word),
wherever it stands, so a wrapped notice counts like one on a line.  The whole text is compared as a licence file with the notices and with
the licences' full texts (license_texts).  A text of at least file_min is a licence file and declares its licence for itself, its
directory and those below; in any other file a header of at least line_min declares one for that file.  A file that declares none inherits from the
nearest ancestor directory that has a licence file (found by joining ancestor paths); of several there, the one with the
highest cosine, then the least licence id, then the least path counts.

Headers and texts that can't reach the least are passed over by an exact bound: without a term that is rare enough, a cosine
is at most the share of the templates' norms in common terms.  Texts are read twice (counts, scores) and never shuffled;
what the driver holds are the templates' terms.  Directories are joined, not files: the join's size follows their number.

Defined results: null and empty texts declare nothing but may inherit; very long texts are compared whole and header by header; a null
path has no directory and inherits nothing; a path is cut at "/" and relative paths count from "/".  Ties between templates go to the
least licence id.  Repeated rows each get a row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from importlib.resources import files as resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import cut

LINE_MIN, FILE_MIN, LINES = 0.8, 0.6, 4

#: (licence id, wording) of notices, and of sentences and paragraphs that stand for a licence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: (licence id, full text).
TEXTS = tuple(sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in resources(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")))


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_terms(pa.array(texts, pa.string()))


def word_terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, doc = tk.words(*tk.codepoints(col))
    return h, doc


def document_frequency(texts: DataFrame, size: int, hits: Callable[[pa.Array], np.ndarray], limit: int = tk.SLICE_BYTES) -> np.ndarray:
    """In how many texts (one column) each of size terms occurs; all texts are read.  hits: the numbers of the terms of each text, each once a text; limit: bytes of text at a time."""
    if not size:
        return np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in tk.slices(batch, 0, limit):
                total += np.bincount(hits(part.column(0)), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "n"])

    out = np.zeros(size, np.int64)
    rows = texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out


def word_hits(keys: np.ndarray) -> Callable[[pa.Array], np.ndarray]:
    def hits(col: pa.Array) -> np.ndarray:
        h, doc = word_terms(col)
        at = tk.lookup(keys, h)
        some = at >= 0
        return np.unique(doc[some] * len(keys) + at[some]) % len(keys)

    return hits


class Scorer:
    """Cosines to one set of templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], keys: np.ndarray, df: np.ndarray, n: int, least: float):
        self.templates = sorted(templates)
        self.ids = np.array([t[0] for t in self.templates], dtype=object)
        h, doc = _terms([t[1] for t in self.templates])
        self.keys = np.unique(h)
        df = df[np.searchsorted(keys, self.keys)]
        self.idf, self.oov = np.log((1 + n) / (1 + df)) + 1, math.log(1 + n) + 1
        tf = np.zeros((len(self.templates), len(self.keys)))
        np.add.at(tf, (doc, tk.lookup(self.keys, h)), 1)
        w = tf * self.idf
        self.unit = w / np.linalg.norm(w, axis=1, keepdims=True)
        rare = df <= 0.05 * n
        if len(self.keys) and np.sqrt((self.unit[:, ~rare] ** 2).sum(1)).max(initial=0) >= least:  # then the bound doesn't hold
            rare[:] = True
        self.rare = np.append(rare, False)

    def marked(self, h: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The units that may reach the least."""
        at = tk.lookup(self.keys, h)
        return np.unique(unit[self.rare[at]])

    def cosines(self, h: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        """(best template's index, cosine, rounded to 6 places) of each of so many units; unit: that of each token, ascending."""
        best, cosine = np.zeros(units, np.int64), np.zeros(units)
        cuts = np.searchsorted(unit, np.arange(0, units + 256, 256))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            u, x = unit[a:b] - i * 256, h[a:b]
            order = np.lexsort((x, u))
            u, x = u[order], x[order]
            head = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (x[1:] != x[:-1])])) if len(u) else np.zeros(0, np.int64)
            k = tk.lookup(self.keys, x[head])
            w = np.diff(np.append(head, len(u))) * np.where(k >= 0, self.idf[k], self.oov)
            n = min(256, units - i * 256)
            norm = np.sqrt(np.bincount(u[head], weights=w * w, minlength=n))
            known = k >= 0
            dense = np.zeros((n, len(self.keys)))
            dense[u[head][known], k[known]] = w[known]
            cos = np.round(dense @ self.unit.T / np.maximum(norm, 1e-300)[:, None], 6)
            best[i * 256 : i * 256 + n] = cos.argmax(1)
            cosine[i * 256 : i * 256 + n] = cos.max(1)
        return best, cosine


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range of each number, the numbers) of the ranges from a up to b, one after the other."""
    n = b - a
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + a[which]


def _headers(cps: np.ndarray, bounds: np.ndarray, start: np.ndarray, doc: np.ndarray, h: np.ndarray, scorer: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first token, token after the last) of the runs of lines and the paragraphs that may reach the least."""
    feeds = np.flatnonzero(cps == 10) + 1
    cuts = np.unique(np.concatenate([bounds[:-1], feeds]))
    cuts = cuts[cuts < max(len(cps), 1)]
    line = np.searchsorted(cuts, start, side="right") - 1
    lines = len(cuts)
    token = np.searchsorted(line, np.arange(lines + 1))  # each line's first
    of = np.searchsorted(bounds[1:], cuts, side="right")
    hit = np.zeros(lines, bool)
    hit[scorer.marked(h, line)] = True
    out = []
    for w in range(1, LINES + 1):
        first = np.unique((np.flatnonzero(hit)[:, None] - np.arange(w)).ravel())
        first = first[(first >= 0) & (first + w <= lines)]
        first = first[of[first] == of[first + w - 1]]
        out.append((of[first], token[first], token[first + w]))
    if lines:
        wordless = np.diff(token) == 0
        opens = np.ones(lines, bool)
        opens[1:] = wordless[:-1] | (of[1:] != of[:-1])
        first = np.flatnonzero(opens)
        after = np.append(first[1:], lines)
        some = np.logical_or.reduceat(hit, first)
        out.append((of[first[some]], token[first[some]], token[after[some]]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _best(ids: np.ndarray, n: int, owner: np.ndarray, best: np.ndarray, cos: np.ndarray) -> tuple[list, np.ndarray]:
    """(licence, cosine) of the best unit of each of n documents, ties by least licence; None and 0 without any."""
    name, score = [None] * n, np.zeros(n)
    for d, t, c in sorted(zip(owner.tolist(), best.tolist(), cos.tolist(), strict=True), key=lambda x: (x[0], -x[2], x[1])):
        if name[d] is None and c > 0:
            name[d], score[d] = ids[t], c
    return name, score


def score(col: pa.Array, header: Scorer, file: Scorer) -> tuple[list, np.ndarray, list, np.ndarray]:
    """(licence, cosine) of the best header and of the whole text, of each document; None and 0 below every bound."""
    cps, bounds = tk.codepoints(col)
    h, start, _, doc = tk.words(cps, bounds)
    owner, a, b = _headers(cps, bounds, start, doc, h, header)
    unit, token = _ranges(a, b)
    out = [*_best(header.ids, len(col), owner, *header.cosines(h[token], unit, len(owner)))]
    owner = file.marked(h, doc)
    unit, token = _ranges(np.searchsorted(doc, owner, side="left"), np.searchsorted(doc, owner, side="right"))
    return (*out, *_best(file.ids, len(col), owner, *file.cosines(h[token], unit, len(owner))))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", notices: tuple[tuple[str, str], ...] = NOTICES, texts: tuple[tuple[str, str], ...] = TEXTS, line_min: float = LINE_MIN, file_min: float = FILE_MIN) -> DataFrame:
    """doc_id, path, license (null: none), how ("own", "inherited", "none"), score (of the own text or header) and from_dir (of an inherited one), for every row of files."""
    rows = files.select(files[id_col].cast("long").alias("doc_id"), files[path_col].cast("string").alias("path"), files[text_col].cast("string").alias("text"))
    keys = np.unique(_terms([t[1] for t in (*notices, *texts)])[0])
    df, n = document_frequency(rows.select("text"), len(keys), word_hits(keys)), rows.count()
    header, file = Scorer(notices, keys, df, n, line_min), Scorer((*notices, *texts), keys, df, n, file_min)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, 2):
                line, cos, whole, full = score(part.column(2), header, file)
                own = [x if c >= line_min else None for x, c in zip(line, cos, strict=True)]
                declared = [x if c >= file_min else None for x, c in zip(whole, full, strict=True)]
                best = [f if x else c if y else None for x, y, f, c in zip(declared, own, full, cos, strict=True)]
                own = [x or y for x, y in zip(declared, own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(own, pa.string()), pa.array(best, pa.float64()), pa.array(declared, pa.string()), pa.array(full)],
                    ["doc_id", "path", "own", "score", "file", "file_score"],
                )

    found = rows.mapInArrow(work, "doc_id long, path string, own string, score double, file string, file_score double")
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    found = cut(found.withColumn("dir", F.when(F.col("path").isNotNull(), F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), "/")))))  # read three times below
    at = F.split(F.col("dir"), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(at)), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(at, 2, i - 1), "/"))))
    best = F.struct((-F.col("file_score")).alias("s"), F.col("file").alias("license"), "path")
    declared = found.where("file IS NOT NULL AND dir IS NOT NULL").groupBy(F.col("dir").alias("up")).agg(F.min(best)["license"].alias("inherited"))
    dirs = found.where("dir IS NOT NULL").select("dir").distinct()
    nearest = dirs.select("dir", F.explode(F.array_distinct(up)).alias("up")).join(declared, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("deep"), F.col("up").alias("from_dir"), "inherited")).alias("x"))
    return found.join(nearest, "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("own", F.col("x.inherited")).alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("x").isNotNull(), "inherited").otherwise("none").alias("how"),
        "score",
        F.when(F.col("own").isNull(), F.col("x.from_dir")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files: source/lang/doc_id."""
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit("unknown"))
    return docs.select(docs["doc_id"], docs["text"], F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id")).alias("path"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(templates: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(sorted(templates)))


SQL = f"""
WITH tpl AS (SELECT 'h' AS side, * FROM (VALUES {_values(NOTICES)}) v(t, license, wording) UNION ALL SELECT 'f', * FROM (VALUES {_values((*NOTICES, *TEXTS))}) v(t, license, wording)),
tt AS (SELECT side, t, term, count(*) AS tf FROM (SELECT side, t, unnest(regexp_extract_all(lower(wording), '[\\p{{L}}\\p{{N}}]+')) AS term FROM tpl) GROUP BY ALL),
docs AS (SELECT doc_id, '/' || source || '/' || lang AS dir, '/' || source || '/' || lang || '/' || doc_id AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS k, len(l) AS many, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
lw AS (SELECT doc_id, k, many, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS w FROM lines),
lp AS (SELECT *, sum((len(w) = 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS para FROM lw),
dt AS (SELECT doc_id, k, many, coalesce(para, 0) AS para, term, count(*) AS tf FROM (SELECT doc_id, k, many, para, unnest(w) AS term FROM lp) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM dt WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT side, term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT side, term FROM tt) LEFT JOIN df USING (term), n),
tw AS (SELECT side, t, term, tf * idf AS w FROM tt JOIN idf USING (side, term)),
tn AS (SELECT side, t, sqrt(sum(w * w)) AS norm FROM tw GROUP BY side, t),
back AS (SELECT w.i AS w, j.i AS j FROM range(1, {LINES + 1}) w(i), range(0, {LINES}) j(i) WHERE j.i < w.i),
u AS (SELECT 'h' AS side, doc_id, w * 100000000 + k - j AS k, term, sum(tf) AS tf FROM dt, back WHERE k - j >= 1 AND k - j + w - 1 <= many GROUP BY ALL
  UNION ALL SELECT 'h', doc_id, para, term, sum(tf) FROM dt GROUP BY ALL
  UNION ALL SELECT 'f', doc_id, 0, term, sum(tf) FROM dt GROUP BY ALL),
uw AS (SELECT u.side, doc_id, k, u.term, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM u LEFT JOIN idf ON u.side = idf.side AND u.term = idf.term, n),
un AS (SELECT side, doc_id, k, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
cs AS (SELECT uw.side, uw.doc_id, uw.k, tw.t, sum(uw.w * tw.w) AS dot FROM uw JOIN tw ON uw.side = tw.side AND uw.term = tw.term GROUP BY ALL),
cc AS (SELECT side, doc_id, k, license, round(dot / un.norm / tn.norm, 6) AS cos FROM cs JOIN un USING (side, doc_id, k) JOIN tn USING (side, t) JOIN tpl USING (side, t)),
own AS (SELECT doc_id, license, cos FROM cc WHERE side = 'h' AND cos >= {LINE_MIN} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, license) = 1),
file AS (SELECT doc_id, license, cos FROM cc WHERE side = 'f' AND cos >= {FILE_MIN} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, license) = 1),
decl AS (SELECT dir AS up, license FROM file JOIN docs USING (doc_id) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cos DESC, license, path) = 1),
near AS (SELECT dir, up AS from_dir, license FROM (SELECT DISTINCT dir FROM docs) JOIN decl ON dir = up OR starts_with(dir, up || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT docs.doc_id, path, coalesce(file.license, own.license, near.license) AS license,
  CASE WHEN coalesce(file.license, own.license) IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  coalesce(file.cos, own.cos) AS score, CASE WHEN coalesce(file.license, own.license) IS NULL THEN from_dir END AS from_dir
FROM docs LEFT JOIN file USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)
"""
