"""Judging retrieval against labelled queries, all configurations in one plan."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metrics
from tessera.operators import patterns

KS = (1, 3, 5, 10)


def ground_truth(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of samples (query_id, relevant_chunk_ids, relevant_doc_names, relevant_keywords).

    A chunk is relevant if it is named, or if its filename or source contains a document name and, where there are
    keywords, its content one of these; case does not count.
    """
    named = samples.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    names = samples.select("query_id", F.transform(F.coalesce("relevant_keywords", F.array().cast("array<string>")), F.lower).alias("keywords"), F.explode("relevant_doc_names").alias("name"))
    names = names.withColumn("name", F.lower("name"))
    place = lambda c: F.lower(F.coalesce(c, F.lit(""))) if c in chunks.columns else F.lit("")
    text = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), place("filename").alias("f"), place("source").alias("s"), F.lower("content").alias("content"))
    # names meet the files, not the chunks; these come by equality
    files = text.select("f", "s").distinct().select("f", "s", F.explode(F.array("f", "s")).alias("t"))
    files = patterns.contained(files, ["f", "s"], "t", names.select(F.col("name").alias("pattern"))).distinct()
    meant = files.join(names.withColumnRenamed("name", "pattern"), "pattern").select("f", "s", "query_id", "keywords")
    free = text.join(meant.where("size(keywords) = 0"), ["f", "s"]).select("query_id", "chunk_id")
    words = meant.select("f", "s", "query_id", F.explode("keywords").alias("pattern")).where("pattern is not null").distinct()
    scanned = text.join(words.select("f", "s").distinct(), ["f", "s"], "left_semi")
    held = patterns.contained(scanned, ["chunk_id", "f", "s"], "content", names.select(F.explode("keywords").alias("pattern")))
    fits = held.join(words, ["f", "s", "pattern"]).select("query_id", "chunk_id")
    return named.unionByName(free).unionByName(fits).distinct()


def containing(samples: DataFrame, chunks: DataFrame, words: int = 3) -> DataFrame:
    """(query_id, chunk_id): the chunks whose content has a sample's `text`, letter by letter.

    Texts of one block of patterns (a checked size) are looked for in every chunk, all at once. Where there are more: a text's inner words stand
    whole in whatever contains it, so a run of ``words`` of them, the longest one, leads to the few chunks that are then searched; of these texts,
    only those with too few inner words, if there are any, are looked for in every chunk.
    """
    wanted = lambda df: patterns.contained(chunks.select("chunk_id", "content"), ["chunk_id"], "content", df.select(F.col("text").alias("pattern"))).join(df.select("query_id", F.col("text").alias("pattern")), "pattern").select("query_id", "chunk_id")
    if samples.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0] < patterns.BLOCK_BYTES:
        return wanted(samples).distinct()
    split = lambda c: F.split(c, r"\s+")
    runs = lambda w, begin, end: F.transform(F.sequence(begin, end), lambda i: F.array_join(F.slice(w, i, F.lit(words)), " "))
    asked = samples.select("query_id", "text", split("text").alias("w"))
    long = asked.where(F.size("w") >= words + 2)
    inner = F.filter(runs(F.col("w"), F.lit(2), F.size("w") - words), lambda r: F.size(F.split(r, " ")) == words)
    keyed = long.select("query_id", "text", F.array_max(F.transform(inner, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"].alias("run"))
    rows = chunks.select("chunk_id", "content", split("content").alias("w")).where(F.size("w") >= words)
    at = rows.select("chunk_id", F.explode(F.array_distinct(F.transform(runs(F.col("w"), F.lit(1), F.size("w") - words + 1), lambda r: F.xxhash64(r)))).alias("h"))
    keyed = keyed.where("run is not null").withColumn("h", F.xxhash64("run"))
    pairs = at.join(keyed.select("h", "query_id", "text"), "h").select("query_id", "text", "chunk_id").distinct()
    found = pairs.join(chunks.select("chunk_id", "content"), "chunk_id").where(F.contains("content", "text"))
    short = asked.where(F.size("w") < words + 2)
    if not short.isEmpty():
        found = found.select("query_id", "chunk_id").unionByName(wanted(short))
    return found.select("query_id", "chunk_id").distinct()


def per_query(hits: DataFrame, truth: DataFrame, ks: Sequence[int] = KS, configs: Sequence[str] | None = None) -> DataFrame:
    """mrr and the metrics at each k, for every query with ground truth (and each of the configurations in the hits' `config`)."""
    by = ["config"] if configs else []
    rows = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    id_ = hits.schema["chunk_id"].dataType
    found = hits.join(truth.select("query_id", F.col("chunk_id").cast(id_).alias("chunk_id")), ["query_id", "chunk_id"]).groupBy(*by, "query_id").agg(F.collect_list("rank").alias("ranks"))
    if configs:
        rows = rows.withColumn("config", F.explode(F.array(*map(F.lit, configs))))
    rows = rows.join(found, [*by, "query_id"], "left").withColumn("ranks", F.array_sort(F.coalesce("ranks", F.array().cast("array<int>"))))
    cols = [metrics.reciprocal_rank("ranks", "n_relevant").alias("mrr")]
    for k in ks:
        cols += [metrics.recall("ranks", "n_relevant", k).alias(f"recall_{k}"), metrics.precision("ranks", k).alias(f"precision_{k}"), metrics.hit_rate("ranks", "n_relevant", k).alias(f"hit_rate_{k}"), metrics.ndcg("ranks", "n_relevant", k).alias(f"ndcg_{k}")]
    return rows.select(*by, "query_id", "n_relevant", *cols)


def summary(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over the queries, and their number."""
    names = [c for c in judged.columns if c not in (*by, "query_id", "n_relevant")]
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("num_samples"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def timed(configurations: Mapping[str, Callable[[], DataFrame]], n_queries: int, path: str) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """The hits of each configuration, written below ``path`` one after the other, and the milliseconds that a query of the batch took."""
    hits, took = {}, {}
    for i, (name, run) in enumerate(configurations.items()):
        began = time.perf_counter()
        made = run().select("query_id", "chunk_id", "rank")
        made.write.mode("overwrite").parquet(f"{path}/hits-{i}")
        took[name] = (time.perf_counter() - began) * 1000 / max(n_queries, 1)
        hits[name] = made.sparkSession.read.schema(made.schema).parquet(f"{path}/hits-{i}")
    return hits, took


def compared(configurations: Mapping[str, DataFrame], truth: DataFrame, ks: Sequence[int] = KS, latency_ms: Mapping[str, float] | None = None) -> DataFrame:
    """One row of means for each configuration's hits, with avg_latency_ms if latencies are given."""
    every = None
    for name, hits in configurations.items():
        one = hits.select(F.lit(name).alias("config"), "query_id", "chunk_id", "rank")
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("nothing to compare")
    out = summary(per_query(every, truth, ks, list(configurations)), ["config"])
    if latency_ms is None:
        return out
    of = F.create_map(*(F.lit(x) for pair in latency_ms.items() for x in pair))
    return out.withColumn("avg_latency_ms", F.round(of[F.col("config")], 3))


def table(rows: DataFrame, k: int = 5) -> str:
    """The comparison as text: one line for each configuration, so a few at most."""
    names = ["config", f"recall_{k}", "mrr", f"ndcg_{k}", f"hit_rate_{k}", *(["avg_latency_ms"] if "avg_latency_ms" in rows.columns else [])]
    lines = [[str(r[c]) if c == "config" else f"{r[c]:.4f}" for c in names] for r in rows.select(*(F.col(c) if c in rows.columns else F.lit(0.0).alias(c) for c in names)).collect()]
    width = [max(len(x[i]) for x in [names, *lines]) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(x, width, strict=True)).rstrip() for x in [names, *lines])
