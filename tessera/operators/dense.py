"""Exact vector search for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.filters import matches
from tessera.sources.shared import written

METRICS = ("cosine", "dot_product", "euclidean")
#: Queries of one matrix product.
BLOCK = 2048
#: Scores of one matrix product (as doubles, 8 MB): so many rows at a time meet a block of queries.
MOST_SCORES = 1 << 20
#: Numbers in the queries that go to the tasks at once (as doubles, 256 MB); more take several passes over the vectors.
MOST_NUMBERS = 1 << 25


def add(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """Appends; ids are not made unique."""
    have, new = (df.select(F.size("embedding")).first() for df in (vectors, more))
    if have and new and have[0] != new[0]:
        raise ValueError(f"vectors have {have[0]} dimensions, the new ones {new[0]}")
    return vectors.unionByName(more)


def delete(table: DataFrame, doc_id: Any) -> DataFrame:
    return table.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def best(hits: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``k`` of each query, with `rank` from 1; ties (scores equal to nine places) go by id."""
    # rint stays with doubles, where round would make a decimal of every score
    order = order or [F.rint(F.col("score") * 1e9).desc(), F.col("chunk_id")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if metric == "euclidean":
        square = (x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None] - 2 * (x @ q.T)
        i, j = np.nonzero(square < 1e-6)  # the difference of large numbers; taken anew, some at a time
        step = max(1, MOST_SCORES // max(x.shape[1], 1))
        for at in range(0, len(i), step):
            some = slice(at, at + step)
            square[i[some], j[some]] = ((x[i[some]] - q[j[some]]) ** 2).sum(axis=1)
        return 1 / (1 + np.sqrt(np.maximum(square, 0)))
    dot = x @ q.T
    if metric == "dot_product":
        return dot
    norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None]
    return dot / np.where(norm == 0, 1e-10, norm)


def top(scores: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) of the best ``k`` rows of each line of ``scores``, ties by id, the lines one after the other; and each line's k-th score, or its last one."""
    n = scores.shape[1]
    most = min(k, n)
    places = np.rint(scores * 1e9)
    least = np.partition(places, n - most, axis=1)[:, n - most]
    query, row = np.nonzero(places >= least[:, None])
    # only what ties with the k-th is more than k
    by_id = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    order = np.lexsort((by_id[row], -places[query, row], query))
    query, row = query[order], row[order]
    begin = np.searchsorted(query, np.arange(len(scores)))
    keep = np.arange(len(query)) - begin[query] < most
    return query[keep], row[keep], least / 1e9


def nearest(metric: str, x: np.ndarray, q: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best ``k`` rows of ``x`` for each of ``q``, and what `top` says of the k-th.

    As many rows as MOST_SCORES allows are scored at a time; only what reaches the k-th score of the rows before is kept of them.
    """
    step = max(1, MOST_SCORES // max(len(q), 1))
    if len(x) <= step:
        scores = _scores(metric, x, q).T
        query, row, least = top(scores, ids, k)
        return query, row, scores[query, row], least
    goal, parts = np.full(len(q), -np.inf), []
    for at in range(0, len(x), step):
        part = ids.slice(at, min(step, len(x) - at))
        scores = _scores(metric, x[at : at + step], q).T
        query, row, least = top(scores, part, k)
        value = scores[query, row]
        good = value >= goal[query] - 2e-9  # ties are told apart below
        parts.append((query[good], at + row[good], value[good]))
        if len(part) >= k:
            goal = np.maximum(goal, least)
    query, row, value = (np.concatenate(c) for c in zip(*parts, strict=True))
    places = np.rint(value * 1e9)
    by_id = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    order = np.lexsort((by_id[row], -places, query))
    begin = np.searchsorted(query[order], np.arange(len(q)))
    order = order[np.arange(len(order)) - begin[query[order]] < k]
    last = np.searchsorted(query[order], np.arange(len(q)), side="right") - 1
    return query[order], row[order], value[order], places[order][last] / 1e9


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", filters: Mapping[str, Any] | None = None, threshold: float | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, dense_score: the ``k`` nearest of ``vectors`` (chunk_id, embedding, ...) to each of
    ``queries`` (query_id, embedding).

    Every Arrow batch meets the queries in blocks, some rows at a time, and gives up its own best ``k``; only these are shuffled.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    # null vectors go in the tasks: a condition on vectors that a plan makes would make them twice
    rows = vectors.where(matches(vectors, filters)).select("chunk_id", "embedding")
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    kind, query_kind = rows.schema["chunk_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_kind}, chunk_id {kind}, score double"

    def hits(ids: pa.Array, matrix: np.ndarray) -> DataFrame:
        # one copy a machine, for all blocks of the pass
        sent = rows.sparkSession.sparkContext.broadcast((ids, matrix))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            for batch in batches:
                if batch.column("embedding").null_count:
                    batch = batch.filter(batch.column("embedding").is_valid())
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("embedding").flatten(), dtype=float).reshape(batch.num_rows, -1)
                if x.shape[1] != matrix.shape[1]:
                    raise ValueError(f"vectors have {x.shape[1]} dimensions, queries {matrix.shape[1]}")
                for at in range(0, len(ids), BLOCK):
                    which, where, value, _ = nearest(metric, x, matrix[at : at + BLOCK], batch.column("chunk_id"), k)
                    keep = np.ones(len(value), bool) if threshold is None else value >= threshold
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + which[keep])), batch.column("chunk_id").take(pa.array(where[keep])), pa.array(value[keep])], names=["query_id", "chunk_id", "score"])

        return rows.mapInArrow(near, schema)

    out = in_passes(asked, hits)
    if out is None:
        out = rows.sparkSession.createDataFrame([], schema)
    return best(out, k).withColumn("dense_score", F.col("score"))


def in_passes(queries: DataFrame, run: Callable[[pa.Array, np.ndarray], DataFrame]) -> DataFrame | None:
    """The results of all passes. Of several, each one's is written before the next one's queries are fetched, so that the driver holds two passes at most; None without queries."""
    passes = _passes(queries)
    first = next(passes, None)
    if first is None:
        return None
    second = next(passes, None)
    if second is None:
        return run(*first)
    out, first = written(run(*first)), None
    while second is not None:
        out = out.unionByName(written(run(*second)))
        second = next(passes, None)
    return out


def _passes(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of as many queries as MOST_NUMBERS allows. The rows come one partition at a time."""
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    held: list = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) * len(row.embedding) >= MOST_NUMBERS:
            yield pa.array([r.query_id for r in held], kind), np.array([r.embedding for r in held], dtype=float)
            held = []
    if held:
        yield pa.array([r.query_id for r in held], kind), np.array([r.embedding for r in held], dtype=float)
