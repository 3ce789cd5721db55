"""What a deployment plugs in: encoders, a re-ranker, a generator.  The defaults are deterministic and need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.retrieval import overlap_score


class Generator(Protocol):
    """Text from a prompt, on the driver."""

    def __call__(self, prompt: str) -> str: ...


#: Texts to vectors, in batches.
Encoder = Callable[[pd.Series], Iterable[list[float]]]
#: (question, text) to a score; greater is better.
Reranker = Callable[[Column, Column], Column]


def encode(text: Column, encoder: Encoder) -> Column:
    """The encoder as a column of array<float>; batches go to Python workers by Arrow."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(batch.fillna(""))))

    return run(text)


def hashing_encoder(dimensions: int = 64) -> Encoder:
    """The offline encoder: signed hashing of words, of unit length (zero for a text without a word)."""

    def run(batch: pd.Series) -> Iterable[list[float]]:
        import re
        import zlib

        import numpy as np

        for text in batch:
            v = np.zeros(dimensions)
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                v[h % dimensions] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            yield (v / n if n else v).tolist()

    return run


lexical_reranker: Reranker = overlap_score


def scored_by(model: Callable[[pd.Series, pd.Series], Iterable[float]], longest: int = 512) -> Reranker:
    """A cross-encoder as a re-ranker: model scores (questions, texts) in batches, which go to Python workers by Arrow; it sees a text's first longest words, as such models do."""

    def rerank(question: Column, text: Column) -> Column:
        @F.pandas_udf("double")
        def run(q: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(list(model(q.fillna(""), t.fillna("").str.split().str[:longest].str.join(" "))), dtype=float)

        return run(question, text)

    return rerank


def echo_generator(prompt: str) -> str:
    """The offline generator: the end of the prompt."""
    return prompt[-200:].strip()


#: What a configuration can name; a deployment registers its own (sentence encoders, cross-encoders, generators of a service).
ENCODERS: dict[str, Callable[[], Encoder]] = {"lexical": hashing_encoder, "hashing": hashing_encoder}
RERANKERS: dict[str, Callable[[], Reranker]] = {"lexical": lambda: lexical_reranker}
GENERATORS: dict[str, Callable[..., Generator]] = {"echo": lambda **_: echo_generator}


def named(registry: dict[str, Callable], name: str) -> Callable:
    """What is registered under the name; an unknown one is an error that lists the known ones."""
    if name not in registry:
        raise ValueError(f"unknown: {name!r}; known: {sorted(registry)}")
    return registry[name]


class Cached:
    """A generator that keeps its answers."""

    def __init__(self, generator: Generator):
        self.generator, self.kept = generator, {}

    def __call__(self, prompt: str) -> str:
        if prompt not in self.kept:
            self.kept[prompt] = self.generator(prompt)
        return self.kept[prompt]


def query_versions(generator: Generator, question: str, n: int) -> list[str]:
    """n wordings of the question, a line each."""
    lines = [x.strip() for x in generator(f"Write {n} versions of this question, one a line: {question}").splitlines() if x.strip()]
    if len(lines) != n:
        raise ValueError(f"{n} versions were asked for, {len(lines)} came")
    return lines


def hypothetical_answer(generator: Generator, question: str) -> str:
    return generator(f"Write a short passage that answers the question: {question}")


def with_history(generator: Generator, question: str, history: str) -> str:
    """The question made independent of the history; unchanged without one."""
    return generator(f"{history}\nRewrite the question so that it can be understood alone: {question}") if history else question
