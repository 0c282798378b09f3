"""Hooks for models: scorers, embedders and writers, in Arrow batches, loaded once a task.

``load`` is a function without arguments that gives the model; it runs on the
executors.  The stand-ins below need no model files.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import ship_code

_WORD = regex.compile(r"[\p{L}\p{N}_]+")


def scored(pairs: DataFrame, load: Callable, question: str = "question", text: str = "text", out: str = "score") -> DataFrame:
    """``pairs`` with the scores of a model (questions, texts) -> numbers; what is no number counts 0, all lie in 0 to 1."""
    ship_code(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            made = pd.to_numeric(pd.Series(list(model(questions, texts)), dtype=object), errors="coerce")
            yield made.astype(float).fillna(0.0).clip(0.0, 1.0)

    return pairs.withColumn(out, score(F.coalesce(question, F.lit("")), F.coalesce(text, F.lit(""))))


def reranked(pairs: DataFrame, load: Callable, k: int | None = None) -> DataFrame:
    """Hits (query_id, doc_id, rank, question, text) by score; ties keep their order; the best ``k``, if given."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_id")
    out = scored(pairs, load).withColumn("reranked", F.row_number().over(order).cast("long"))
    return out.filter(F.col("reranked") <= k) if k else out


def embedded(texts: DataFrame, load: Callable, text: str = "text", out: str = "embedding") -> DataFrame:
    """``texts`` with the vectors of a model texts -> vectors."""
    ship_code(texts.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model(batch)))

    return texts.withColumn(out, embed(F.coalesce(text, F.lit(""))))


def hypothetical(questions: DataFrame, written: Column, load: Callable) -> DataFrame:
    """query_id, query_vector: what a writer answers to a question (``written``; null or empty: the question) as a vector."""
    answers = questions.select("query_id", F.coalesce(F.nullif(F.trim(written), F.lit("")), "text").alias("text"))
    return embedded(answers, load, out="query_vector").select("query_id", "query_vector")


def word_share() -> Callable:
    """Stand-in scorer: the share of a question's words that a text holds."""

    def model(questions: pd.Series, texts: pd.Series) -> list[float]:
        words = lambda t: set(_WORD.findall(t.lower()))
        asked = {q: words(q) for q in set(questions)}
        return [round(len(asked[q] & words(t)) / max(len(asked[q]), 1), 6) for q, t in zip(questions, texts, strict=True)]

    return model


def hashed_words(width: int = 64) -> Callable:
    """Stand-in embedder: word counts by hash, of unit length."""

    def model(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for t in texts:
            at = [zlib.crc32(w.encode()) % width for w in _WORD.findall(t.lower())]
            v = np.bincount(at, minlength=width).astype(np.float64)
            out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
        return out

    return model
