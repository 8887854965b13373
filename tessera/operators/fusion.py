"""Fusing two ranked lists for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dense import best

FUSIONS = ("rrf", "linear")


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both lists side by side, each with its number of results for the query."""
    side = lambda hits, s: hits.select("query_id", "chunk_id", F.col("score").alias(f"{s}_score"), F.col("rank").alias(f"{s}_rank"))
    both = side(dense, "dense").join(side(sparse, "bm25"), ["query_id", "chunk_id"], "full")
    w = Window.partitionBy("query_id")
    return both.withColumn("n_dense", F.count("dense_rank").over(w)).withColumn("n_sparse", F.count("bm25_rank").over(w))


def fused(dense: DataFrame, sparse: DataFrame, k: int = 5, fusion: str = "rrf", rrf_k: int = 60, alpha: float = 0.5) -> DataFrame:
    """query_id, rank, chunk_id, score, dense_score, bm25_score, rrf_score.

    A query that only one side answers keeps that side's list as it is, without an rrf_score.
    """
    if fusion not in FUSIONS:
        raise ValueError(f"unknown fusion: {fusion}")
    both = _both(dense, sparse)
    two = (F.col("n_dense") > 0) & (F.col("n_sparse") > 0)
    if fusion == "rrf":
        part = lambda s: F.coalesce(F.lit(1.0) / (rrf_k + F.col(f"{s}_rank")), F.lit(0.0))
        score = part("dense") + part("bm25")
    else:
        w = Window.partitionBy("query_id")

        def scaled(c: str):
            low, high = F.min(c).over(w), F.max(c).over(w)
            span = F.when(high - low > 1e-6, high - low).otherwise(1.0)
            return F.coalesce(F.when(high - low > 1e-6, F.col(c) - low).otherwise(F.lit(0.0)) / span, F.lit(0.0))

        score = F.when(F.col("dense_rank").isNotNull(), alpha * scaled("dense_score")).otherwise(0.0) + F.when(F.col("bm25_rank").isNotNull(), (1 - alpha) * scaled("bm25_score")).otherwise(0.0)
    both = both.withColumn("_mixed", score).withColumn("score", F.when(two, F.col("_mixed")).otherwise(F.coalesce("dense_score", "bm25_score")))
    both = both.withColumn("rrf_score", F.when(two, F.col("_mixed")) if fusion == "rrf" else F.lit(None).cast("double"))
    alone = F.when(~two, F.coalesce("dense_rank", "bm25_rank"))
    ties = [F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last()] if fusion == "rrf" else []
    order = [alone, F.round("score", 9).desc(), *ties, F.col("chunk_id")]
    return best(both, k, order).select("query_id", "rank", "chunk_id", "score", "dense_score", "bm25_score", "rrf_score")


def candidates(k: int, multiplier: int = 3) -> int:
    """How many results each side gives."""
    return max(k * multiplier, 20)
