"""Reranking hits (query_id, rank, chunk_id, score, ...)."""

from __future__ import annotations

import importlib.util
import warnings
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dense import best


def passthrough(hits: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` as they are."""
    return hits.where(F.col("rank") <= k).withColumn("rerank_score", F.col("score"))


def scored(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """Ordered by another score, a column of the hits (with query_text and content); ties keep their order."""
    again = hits.withColumn("rerank_score", score)
    return best(again.withColumnRenamed("rank", "_before"), k, [F.round("rerank_score", 9).desc(), F.col("_before")]).drop("_before")


def pairwise(load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], query: str = "query_text", content: str = "content") -> Column:
    """A score of (query, content) pairs by a model that each Python worker loads once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, c in batches:
            yield pd.Series([float(s) for s in model(list(zip(q.fillna(""), c.fillna(""), strict=True)))], dtype=float)

    return score(query, content)


def default_score() -> Column | None:
    """A cross encoder where its package is installed, else None (hits keep their order), with a warning."""
    if importlib.util.find_spec("sentence_transformers"):
        return cross_encoder()
    warnings.warn("sentence-transformers is not installed; hits are not reranked", stacklevel=3)
    return None


def cross_encoder(name: str = "cross-encoder/ms-marco-MiniLM-L-6-v2", device: str | None = None) -> Column:
    """Needs the sentence-transformers package on the executors; raw model scores."""

    def load():
        from sentence_transformers import CrossEncoder

        model = CrossEncoder(name, device=device)
        return lambda pairs: model.predict(pairs)

    return pairwise(load)
