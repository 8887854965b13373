"""Retrieval from end to end: ingest, search, inspect, answer, compare."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dense, evaluate, fusion, generate, prompt, rerank, sparse
from tessera.operators.embeddings import default_embeddings
from tessera.operators.index import Manager
from tessera.sources import loaders

MODES = ("dense", "sparse", "bm25", "hybrid")


class Retrieval:
    """An index, and how it is searched. Queries are tables (query_id, text), answered all at once.

    `neural` takes models where their package is installed, and says so where it is not.
    """

    @classmethod
    def neural(cls, spark: SparkSession, path: str, **how) -> Retrieval:
        return cls(Manager(spark, path, default_embeddings()), rerank_score=rerank.default_score(), **how)

    def __init__(self, manager: Manager, fusion_kind: str = "rrf", rrf_k: int = 60, alpha: float = 0.5, rerank_score=None, answer=None):
        self.manager, self.fusion_kind, self.rrf_k, self.alpha = manager, fusion_kind, rrf_k, alpha
        self.rerank_score, self.answer = rerank_score, answer

    def ingest_directory(self, path: str, recursive: bool = True, force: bool = False) -> dict[str, int]:
        docs, _ = loaders.directory_documents(self.manager.spark, path, recursive)
        return self.manager.index_documents(docs, force)

    def ingest_file(self, path: str, force: bool = False) -> dict[str, int]:
        return self.manager.index_documents(loaders.file_documents(self.manager.spark, path), force)

    def ingest_texts(self, texts, metadatas=None, force: bool = False) -> dict[str, int]:
        return self.manager.index_documents(loaders.texts(self.manager.spark, texts, metadatas), force)

    def ingest_table(self, df: DataFrame, force: bool = False) -> dict[str, int]:
        return self.manager.index_documents(loaders.from_table(df), force)

    def _dense(self, queries: DataFrame, k: int, filters: Mapping[str, Any] | None) -> DataFrame:
        m = self.manager
        vectors = m.table("vectors", filters)
        asked = queries.select("query_id", m.embeddings.queries("text").alias("embedding"))
        return dense.search(vectors, asked, k, m.metric, filters)

    def _sparse(self, queries: DataFrame, k: int, filters: Mapping[str, Any] | None) -> DataFrame:
        return sparse.search(self.manager.index(), queries, k, self.manager.table("vectors", filters), filters)

    def retrieve(self, queries: DataFrame, k: int = 5, mode: str = "hybrid", filters: Mapping[str, Any] | None = None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}")
        if mode == "dense":
            return self._dense(queries, k, filters)
        if mode in ("sparse", "bm25"):
            return self._sparse(queries, k, filters)
        most = fusion.candidates(k)
        return fusion.fused(self._dense(queries, most, filters), self._sparse(queries, most, filters), k, self.fusion_kind, self.rrf_k, self.alpha)

    def search(self, queries: DataFrame, k: int = 5, mode: str = "hybrid", filters: Mapping[str, Any] | None = None, reranked: bool = True, candidate_k: int = 20) -> DataFrame:
        """Hits with the chunks' columns; models see candidates only, above the top-k."""
        hits = self.retrieve(queries, candidate_k if reranked else k, mode, filters)
        hits = hits.join(self.manager.table("chunks"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
        if not reranked:
            return hits.where(F.col("rank") <= k)
        return rerank.passthrough(hits, k) if self.rerank_score is None else rerank.scored(hits, self.rerank_score, k)

    def inspect(self, queries: DataFrame, k: int = 5, filters: Mapping[str, Any] | None = None, candidate_k: int = 20) -> DataFrame:
        """Every stage's score."""
        out = self.search(queries, k, "hybrid", filters, True, candidate_k)
        return out.select("query_id", "rank", "chunk_id", "content", "score", "dense_score", "bm25_score", "rrf_score", "rerank_score")

    def query(self, queries: DataFrame, k: int = 5, mode: str = "hybrid", filters: Mapping[str, Any] | None = None, reranked: bool = True, candidate_k: int = 20) -> DataFrame:
        """query_id, query_text, answer, citations, prompts."""
        contexts = prompt.context(queries, self.search(queries, k, mode, filters, reranked, candidate_k))
        return prompt.prompts(contexts).withColumn("answer", generate.mock_answer() if self.answer is None else self.answer)

    def measured(self, queries: DataFrame, path: str, **how) -> DataFrame:
        """`query`, with its result written to ``path``, and latency_ms: what a query of the batch took."""
        began = time.perf_counter()
        made = self.query(queries, **how)
        made.write.mode("overwrite").parquet(path)
        took = (time.perf_counter() - began) * 1000
        return queries.sparkSession.read.schema(made.schema).parquet(path).withColumn("latency_ms", F.lit(took) / F.lit(max(queries.count(), 1)))

    def compare(self, samples: DataFrame, ks=evaluate.KS, candidate_k: int = 20) -> DataFrame:
        """Keyword, vector, fused and reranked search over labelled queries, with the time that a query of the batch took."""
        most = max(ks)
        queries = samples.select("query_id", "text")
        truth = evaluate.ground_truth(samples, self.manager.table("chunks"))
        runs = {name: lambda mode=mode: self.retrieve(queries, most, mode) for name, mode in (("BM25", "sparse"), ("Dense", "dense"), ("Hybrid RRF", "hybrid"))}
        runs["Hybrid + Reranker"] = lambda: self.search(queries, most, "hybrid", None, True, candidate_k)
        hits, took = evaluate.timed(runs, queries.count(), f"{self.manager.path}/compared-{uuid.uuid4().hex}")
        return evaluate.compared(hits, truth, ks, took)
