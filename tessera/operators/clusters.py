"""Exact vector search that passes over what can't be among the best: clusters with a centre and a radius.

Vectors are dealt to the nearest of some centres and written by cluster, with the largest distance from the centre that any has. That bounds every score
of a cluster: a distance to a query is at least that of the centre less the radius (triangle inequality), and a product with a query at most
the centre's and the query's length times the radius (Cauchy-Schwarz; for the cosine, of vectors of length one). A query first
meets its nearest cluster, whose k-th score is its goal; then every other cluster whose bound reaches the goal. No hit is lost, and none is approximate.

Centres are fitted on a bounded sample; where they lie decides what is passed over, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.functions.filters import matches
from tessera.operators import dense
from tessera.sources.shared import written

#: Vectors that centres are fitted on, at most, those with the smallest hash of their id; and how often they are moved.
SAMPLE = 16_384
ROUNDS = 8
#: Centres, at most; else the square root of the number of vectors.
MOST_CENTRES = 2048
#: Bounds are widened by this much, and scores are told apart by no less.
SLACK = 2e-9


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm == 0, 1, norm)[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T), 0))


def assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of ``centres`` to each row of ``x``, some rows at a time."""
    step = max(1, dense.MOST_SCORES // max(len(centres), 1))
    return np.concatenate([np.empty(0, np.int64), *(distances(x[at : at + step], centres).argmin(axis=1) for at in range(0, len(x), step))])


def fitted(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` centres of the rows of ``x``, or fewer: means of what is nearest to each, from evenly spread rows on."""
    centres = np.unique(x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        near = assigned(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("embedding").flatten(), dtype=float).reshape(batch.num_rows, -1)


@dataclass
class Clusters:
    """``rows`` (cluster, chunk_id, embedding, ...) in order of cluster; each cluster's centre and radius; ``size`` of each."""

    rows: DataFrame
    metric: str
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, metric: str = "cosine", most: int = MOST_CENTRES, path: str | None = None) -> Clusters:
        """Deals vectors (chunk_id, embedding, ...) to clusters. Rows without an embedding are left out."""
        if metric not in dense.METRICS:
            raise ValueError(f"unknown metric: {metric}")
        rows = vectors.where("embedding is not null")
        spark, space = rows.sparkSession, unit if metric == "cosine" else np.asarray
        n = rows.count()
        sample = [r.embedding for r in rows.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()]
        if len({len(x) for x in sample}) > 1:
            raise ValueError("vectors have different dimensions")
        centres = fitted(space(np.array(sample, dtype=float)), max(1, min(most, round(n**0.5)))) if n else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast(centres)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = space(_matrix(batch))
                    if x.shape[1] != sent.value.shape[1]:
                        raise ValueError("vectors have different dimensions")
                    near = assigned(x, sent.value)
                    # taken anew: the difference of large numbers is not exact
                    apart = np.sqrt(((x - sent.value[near]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(apart)], names=[*batch.schema.names, "cluster", "apart"])

        schema = rows.schema
        for name in ("cluster", "apart"):
            if name in schema.names:
                raise ValueError(f"the vectors have a column {name}")
        kept = rows.mapInArrow(dealt, StructType([*schema.fields, StructField("cluster", IntegerType()), StructField("apart", DoubleType())])) if n else rows.withColumns({"cluster": F.lit(0), "apart": F.lit(0.0)})
        # a cluster of very many vectors is dealt out by their ids
        kept = written(kept.repartitionByRange("cluster", F.xxhash64("chunk_id")).sortWithinPartitions("cluster"), path)
        radius, size = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
        for r in kept.groupBy("cluster").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # MOST_CENTRES rows at most
            if n:
                radius[r.cluster], size[r.cluster] = r.radius, r.n
        return cls(kept, metric, centres, radius, size)

    def search(self, queries: DataFrame, k: int = 5, filters: Mapping[str, Any] | None = None, threshold: float | None = None, scored: Accumulator | None = None) -> DataFrame:
        """What `dense.search` finds over all vectors; ``scored`` is raised by the number of (query, vector) pairs that were scored."""
        kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((self.rows, "chunk_id"), (queries, "query_id")))
        rows = self.rows.where(matches(self.rows, filters)).select("cluster", "chunk_id", "embedding")
        schema = f"query_id {query_kind}, chunk_id {kind}, score double"
        run = lambda ids, matrix: self._hits(rows, ids, matrix, k, threshold, schema, scored)
        found = dense.in_passes(queries.where("embedding is not null").select("query_id", "embedding"), run)
        return dense.best(rows.sparkSession.createDataFrame([], schema) if found is None else found, k).withColumn("dense_score", F.col("score"))

    def bounds(self, matrix: np.ndarray, clusters: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The highest score that any vector of each of these clusters can have, for every query."""
        centres, radius = self.centres[clusters], self.radius[clusters]
        if self.metric == "euclidean":
            return 1 / (1 + np.maximum(distances(matrix, centres) - radius * (1 + SLACK) - SLACK, 0)) + SLACK
        q = unit(matrix) if self.metric == "cosine" else matrix
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        return (q @ centres.T + length * radius) + SLACK * (1 + length * (1 + radius + np.abs(centres).max(initial=0)))

    def _nearest(self, matrix: np.ndarray) -> np.ndarray:
        """Each query's cluster with the nearest centre, in blocks of queries."""
        q = unit(matrix) if self.metric == "cosine" else matrix
        near = [distances(q[at : at + dense.BLOCK], self.centres) if self.metric != "dot_product" else -(q[at : at + dense.BLOCK] @ self.centres.T) for at in range(0, len(q), dense.BLOCK)]
        return np.concatenate([np.where(self.size > 0, x, np.inf).argmin(axis=1) for x in near])

    def _hits(self, rows: DataFrame, ids: pa.Array, matrix: np.ndarray, k: int, threshold: float | None, schema: str, scored: Accumulator | None) -> DataFrame:
        if len(self.centres) and matrix.shape[1] != self.centres.shape[1]:
            raise ValueError(f"vectors have {self.centres.shape[1]} dimensions, queries {matrix.shape[1]}")
        context = rows.sparkSession.sparkContext
        low = -np.inf if threshold is None else threshold
        if not len(self.centres):
            return rows.sparkSession.createDataFrame([], schema)
        first = self._nearest(matrix)
        plain = Clusters(None, self.metric, self.centres, self.radius, self.size)
        sent = context.broadcast((plain, ids, matrix, first))

        def scores(goal: np.ndarray, lead: bool):
            held = context.broadcast(goal)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                self, ids, matrix, first = sent.value
                goal = held.value.copy()
                for batch in batches:
                    cluster = np.asarray(batch.column("cluster"))
                    cuts = np.flatnonzero(np.diff(cluster)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cluster)], strict=True):
                        if a == b:
                            continue
                        part, c = batch.slice(a, b - a), int(cluster[a])
                        x = _matrix(part)
                        for at in range(0, len(ids), dense.BLOCK):
                            q = slice(at, at + dense.BLOCK)
                            met = first[q] == c
                            who = at + np.flatnonzero(met if lead else ~met & (self.bounds(matrix[q], np.array([c]))[:, 0] >= goal[q]))
                            if not len(who):
                                continue
                            if scored is not None:
                                scored.add(len(who) * len(x))
                            which, where, value, least = dense.nearest(self.metric, x, matrix[who], part.column("chunk_id"), k)
                            if len(x) >= k:
                                goal[who] = np.maximum(goal[who], least - SLACK)
                            good = (value >= low) & (value >= goal[who[which]] - SLACK)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[which[good]])), part.column("chunk_id").take(pa.array(where[good])), pa.array(value[good])], names=["query_id", "chunk_id", "score"])

            return run

        # both read only clusters that some query needs, by the files' statistics
        lead = written(rows.where(F.col("cluster").isin(np.unique(first).tolist())).mapInArrow(scores(np.full(len(ids), low), True), schema))
        goal, place = np.full(len(ids), low), {x: i for i, x in enumerate(ids.to_pylist())}
        for r in dense.best(lead, k).where(F.col("rank") == k).select("query_id", "score").collect():  # of the pass's queries
            goal[place[r.query_id]] = max(low, r.score - SLACK)
        return lead.unionByName(rows.mapInArrow(scores(goal, False), schema))
