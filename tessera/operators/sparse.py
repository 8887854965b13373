"""BM25 over an inverted index of ordinary tables.

Two kinds of index are searched. One made for a search (`build`) keeps the terms of every chunk, written once; statistics,
vocabulary and scores are made from these: as the terms of a chunk are together, each Arrow batch of chunks is scored for itself, and only its best
``k`` for each query are shuffled. One that is kept (`Blocks`, by the index's manager) has its postings in blocks: a row holds a
term's postings in one block of chunks of like length, with the largest count and the shortest length among them. These bound what any of the
block's chunks can score, so a search first reads the bounds alone, and then the postings of those blocks that
may hold one of the best: block-max pruning, exact to the last hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.batches import runs
from tessera.functions.filters import matches
from tessera.functions.text import let, terms
from tessera.operators.dense import BLOCK as QUERIES
from tessera.operators.dense import best, top
from tessera.sources.shared import written


@dataclass(frozen=True)
class BM25:
    k1: float = 1.5
    b: float = 0.75
    stopwords: tuple[str, ...] | None = None


#: (query, term) rows that are sent to all executors at most: a few MB.
MOST_ASKED = 100_000
#: Scores that a task holds at once.
MOST_SCORES = 1 << 22
#: Terms, and counts that meet a query, that a task works on at once.
MOST_TERMS = 1 << 18
#: Chunks of one block of postings, about.
BLOCK = 64
#: Folders that terms are dealt to by hash, so that a search reads those of its terms only.
BUCKETS = 16
#: (query, block) rows that are sent to all executors at most: some ten MB.
MOST_BLOCKS = 500_000
#: Blocks that are scored first for each query, those with the highest bounds.
LEAD = 4


@dataclass
class Index:
    """tokens (chunk_id, tokens, doc_len), written; the number of chunks, and their mean length."""

    tokens: DataFrame
    n: int
    avgdl: float
    params: BM25

    @property
    def occurrences(self) -> DataFrame:
        """(term, chunk_id, doc_len, tf), in which a term may have several rows for a chunk."""
        return occurrences_of(self.tokens)

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_id, doc_len, tf)."""
        return summed(self.occurrences)

    @property
    def vocab(self) -> DataFrame:
        """(term, df, idf)."""
        return vocab_of(self.postings, self.n)

    @property
    def corpus_stats(self) -> DataFrame:
        """(n, avgdl): one row."""
        return self.tokens.sparkSession.createDataFrame([(self.n, self.avgdl)], "n long, avgdl double")


@dataclass
class Blocks:
    """A kept index: ``rows`` as `blocked` makes them, with the ``seq`` of their segment; ``frequencies`` (bucket, term, df), signed differences
    of which a term may have several; ``gone`` (doc_id, gone), None if there are none: chunks of such a document count from segment ``gone`` on."""

    rows: DataFrame
    frequencies: DataFrame
    gone: DataFrame | None
    n: int
    avgdl: float
    params: BM25

    @property
    def vocab(self) -> DataFrame:
        """(term, df, idf), from the differences: no posting is read."""
        df = self.frequencies.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.withColumn("idf", idf(self.n))

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_id, doc_len, tf) of the chunks that are not gone."""
        return alive(self.rows.select("seq", "term", F.inline("postings")), self.gone).select("term", "chunk_id", "doc_len", "tf")

    @property
    def corpus_stats(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([(self.n, self.avgdl)], "n long, avgdl double")


def lengths(chunks: DataFrame, stopwords: Iterable[str] | None = None) -> DataFrame:
    """(chunk_id, tokens, doc_len) of chunks (chunk_id, content)."""
    return chunks.select("chunk_id", F.coalesce(terms("content", stopwords), F.array().cast("array<string>")).alias("tokens")).withColumn("doc_len", F.size("tokens"))


def occurrences_of(tokens: DataFrame) -> DataFrame:
    """A row for each term of each chunk; nothing is shuffled. Give it rows that are written: a plan would make the terms for the length, and again for the rows."""
    more = [c for c in tokens.columns if c not in ("tokens", "chunk_id", "doc_len")]
    return tokens.select(F.explode("tokens").alias("term"), "chunk_id", "doc_len", F.lit(1).cast("long").alias("tf"), *more)


def summed(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("term", "chunk_id", "doc_len", *(c for c in occurrences.columns if c not in ("term", "chunk_id", "doc_len", "tf"))).agg(F.sum("tf").alias("tf"))


def counted(tokens: Column | str) -> Column:
    """The different terms of an array, sorted, each with its tf: counted within the row, in time of sorting it."""
    length = lambda s: F.size(s)
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    rows = lambda s, at: F.transform(at, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, n + 1), length(s)) - i).cast("long").alias("tf")))
    return let(F.sort_array(tokens), lambda s: let(begins(s), lambda at: rows(s, at)))


def forward(tokens: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, doc_len, counts) of tokens (chunk_id, doc_id, tokens, doc_len): the postings of each chunk together. Nothing is shuffled."""
    return tokens.select("chunk_id", "doc_id", "doc_len", counted("tokens").alias("counts"))


def postings_of(tokens: DataFrame) -> DataFrame:
    """Counts of terms within each chunk."""
    return summed(occurrences_of(tokens))


def stats_of(tokens: DataFrame) -> DataFrame:
    """Chunks without terms count too."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum("doc_len"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avgdl"))


def idf(n: int, df: str = "df") -> Column:
    return F.greatest(F.lit(1e-6), F.log((n - F.col(df) + 0.5) / (F.col(df) + 0.5) + 1))


def vocab_of(postings: DataFrame, n: int) -> DataFrame:
    # counting tf, which is never null, keeps the plan of the postings as it is elsewhere, so that Spark makes them once
    return postings.groupBy("term").agg(F.count("tf").alias("df")).withColumn("idf", idf(n))


def build(chunks: DataFrame, params: BM25 = BM25()) -> Index:
    """An index of chunks (chunk_id, content): their terms, written once; these are counted where they are asked for."""
    tokens = written(lengths(chunks, params.stopwords))
    stats = stats_of(tokens).first()
    return Index(tokens, stats.n, stats.avgdl, params)


def bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def blocked(postings: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """bucket, term, block, df, most_tf, least_len, postings: postings (term, chunk_id, doc_id, doc_len, tf) by term and block, sorted by term.

    A block has about BLOCK chunks whose lengths are alike within a factor of the square root of two. ``chunks`` (chunk_id, doc_len) are those of
    the postings, where they are at hand; else their number is estimated.
    """
    kind = F.floor(2 * F.log2(F.col("doc_len"))).cast("long")
    # a bounded number of kinds: two for each doubling of a length
    # a sketch will do where there are only postings: no posting is shuffled for it
    number = F.count(F.lit(1)) if chunks is not None else F.greatest(F.approx_count_distinct("chunk_id"), F.lit(1))
    sizes = {r.kind: r.n for r in (postings if chunks is None else chunks).where("doc_len > 0").groupBy(kind.alias("kind")).agg(number.alias("n")).collect()}
    parts = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, -(-n // BLOCK)))) if sizes else F.lit(None).cast("map<bigint,int>")
    block = F.shiftleft(kind, 40) + F.pmod(F.xxhash64("chunk_id"), F.try_element_at(parts, kind))
    # one shuffle, by ranges that keep a term's block together, both groups the rows and sorts them
    by = ["bucket", "term", "block"]
    rows = postings.select(bucket().alias("bucket"), "term", block.alias("block"), F.struct("chunk_id", "doc_id", "doc_len", "tf").alias("posting")).repartitionByRange(*by)
    rows = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("df"), F.max("posting.tf").alias("most_tf"), F.min("posting.doc_len").alias("least_len"), F.collect_list("posting").alias("postings")
    )
    return rows.sortWithinPartitions(*by)


def alive(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """``rows`` (seq, doc_id, ...) of segments without those whose document was taken out or replaced by a later one."""
    if gone is None:
        return rows
    return rows.join(gone, "doc_id", "left").where("gone is null or seq >= gone").select(*rows.columns)


def _asked(queries: DataFrame, params: BM25) -> DataFrame:
    return queries.select("query_id", F.explode(terms("text", params.stopwords)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _share(p: BM25, avgdl: float, tf: str, doc_len: str) -> Column:
    """What a term's count gives, without its weight."""
    norm = F.lit(1 - p.b) + F.lit(p.b) * F.col(doc_len) / F.lit(avgdl or 1.0)
    return F.col(tf) * (p.k1 + 1) / (F.col(tf) + p.k1 * norm)


def search(index: Index | Blocks, queries: DataFrame, k: int = 5, chunks: DataFrame | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, bm25_score: the best ``k`` chunks for each of ``queries`` (query_id, text).

    A term that a query repeats counts as often. ``filters`` hold for ``chunks`` (chunk_id and metadata) and change no
    statistics. Terms that no query has are left out before anything is counted or shuffled. Up to MOST_ASKED (query, term) rows are sent to
    the tasks; beyond that both sides are shuffled by term.
    """
    p = index.params
    kept = chunks.where(matches(chunks, filters)).select("chunk_id") if filters else None
    asked = _asked(queries, p)
    if isinstance(index, Blocks):
        return Pruned(index, asked, k, kept).hits()
    asked = written(asked)
    scored = _in_batches(index, asked, k, kept) if asked.count() <= MOST_ASKED else _shuffled(index, asked, kept)
    return best(scored, k).withColumn("bm25_score", F.col("score"))


def _shuffled(index: Index, asked: DataFrame, kept: DataFrame | None) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that hold a term, however many queries there are."""
    found = summed(index.occurrences.join(asked.select("term").distinct(), "term", "left_semi"))
    asked = asked.join(vocab_of(found, index.n).drop("df"), "term")
    part = F.col("times") * F.col("idf") * _share(index.params, index.avgdl, "tf", "doc_len")
    if kept is not None:
        found = found.join(kept, "chunk_id", "left_semi")
    return found.join(asked, "term").select("query_id", "chunk_id", part.alias("part")).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def _counts(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, term, tf) of those ``terms`` that the chunks of a batch hold."""
    tokens = batch.column("tokens")
    term = pc.index_in(tokens.flatten(), value_set=terms).fill_null(-1).to_numpy()
    chunk = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(tokens.offsets)))
    keys, tf = np.unique(chunk[term >= 0] * len(terms) + term[term >= 0], return_counts=True)
    return keys // len(terms), keys % len(terms), tf


def _in_batches(index: Index, asked: DataFrame, k: int, kept: DataFrame | None) -> DataFrame:
    """(query_id, chunk_id, score): the best ``k`` for each query of every Arrow batch. At most MOST_ASKED rows of ``asked`` go to the tasks."""
    spark, p, avgdl = asked.sparkSession, index.params, index.avgdl or 1.0
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {index.tokens.schema['chunk_id'].dataType.simpleString()}, score double"
    rows = asked.orderBy("query_id", "term").collect()
    if not rows:
        return spark.createDataFrame([], schema)
    terms = pa.array(sorted({r.term for r in rows}))
    number, place = {t: i for i, t in enumerate(terms.to_pylist())}, {}
    for r in rows:
        place.setdefault(r.query_id, len(place))
    ids = pa.array(list(place), to_arrow_type(asked.schema["query_id"].dataType))
    words = spark.sparkContext.broadcast(terms)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(words.value), dtype=np.int64)
        for batch in batches:
            for a, b in runs(np.asarray(batch.column("tokens").offsets), MOST_TERMS):
                df += np.bincount(_counts(batch.slice(a, b - a), words.value)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    df = np.zeros(len(terms))
    for r in index.tokens.select("tokens").mapInArrow(held, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    idf_ = np.maximum(1e-6, np.log((index.n - df + 0.5) / (df + 0.5) + 1))
    # what each term is asked by: queries in order, and the weight it has there
    by = sorted((number[r.term], place[r.query_id], r.times) for r in rows)
    term = np.array([x[0] for x in by])
    query, weight = np.array([x[1] for x in by]), np.array([x[2] for x in by]) * idf_[term]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    sent = spark.sparkContext.broadcast((terms, ids, query, weight, first))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, query, weight, first = sent.value
        width = min(len(ids), QUERIES)
        held = np.zeros((len(ids), k))  # each query's best scores so far
        for whole in batches:
            for i, j in runs(np.asarray(whole.column("tokens").offsets), MOST_TERMS, max(1, MOST_SCORES // width)):
                part = whole.slice(i, j - i)
                counted = _counts(part, terms)
                often = first[counted[1] + 1] - first[counted[1]]
                met = np.concatenate([[0], np.cumsum(np.bincount(counted[0], weights=often, minlength=part.num_rows))])
                for a, b in runs(met, MOST_TERMS):
                    batch, own = part.slice(a, b - a), slice(*np.searchsorted(counted[0], [a, b]))
                    chunk, term, tf = counted[0][own] - a, counted[1][own], counted[2][own]
                    norm = (1 - p.b) + p.b * batch.column("doc_len").to_numpy() / avgdl
                    share = tf * (p.k1 + 1) / (tf + p.k1 * norm[chunk])
                    # each count meets the queries that ask for its term
                    pair = np.repeat(np.arange(len(term)), often[own])
                    entry = np.arange(len(pair)) - np.repeat(np.cumsum(often[own]) - often[own], often[own]) + first[term[pair]]
                    value, who, where = weight[entry] * share[pair], query[entry], chunk[pair]
                    for low in range(0, len(ids), width):
                        own_ = slice(None) if width == len(ids) else np.flatnonzero((who >= low) & (who < low + width))
                        size = min(width, len(ids) - low)
                        total = np.bincount((who[own_] - low) * batch.num_rows + where[own_], weights=value[own_], minlength=size * batch.num_rows).astype(float).reshape(size, batch.num_rows)
                        which, row, _ = top(total, batch.column("chunk_id"), k)
                        got = total[which, row]
                        # only what reaches the k-th score so far; scores are told apart to nine places
                        good = (got > 0) & (got >= held[low + which, -1] - 2e-9)
                        which, row, got = which[good], row[good], got[good]
                        best_ = np.zeros((size, k))
                        best_[which, np.arange(len(which)) - np.searchsorted(which, np.arange(size))[which]] = got
                        held[low : low + size] = np.sort(np.concatenate([held[low : low + size], best_], axis=1), axis=1)[:, : k - 1 : -1]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(low + which)), batch.column("chunk_id").take(pa.array(row)), pa.array(got)], names=["query_id", "chunk_id", "score"])

    tokens = index.tokens if kept is None else index.tokens.join(kept, "chunk_id", "left_semi")
    return tokens.select("chunk_id", "tokens", "doc_len").mapInArrow(scores, schema)


class Pruned:
    """A search of a kept index. ``bounds`` has a row for each query and block: what a chunk of it scores at most, whether it is
    among the query's first LEAD, and whether it needs to be read."""

    def __init__(self, index: Blocks, asked: DataFrame, k: int, kept: DataFrame | None = None):
        self.index, self.k, self.kept = index, k, kept
        asked = written(asked.withColumn("bucket", bucket()))
        self.few = asked.count() <= MOST_ASKED
        self.side = F.broadcast if self.few else lambda df: df
        # at most BUCKETS numbers: only these folders are read
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
        words = self.side(asked.select("term").distinct())
        df = index.frequencies.where(F.col("bucket").isin(buckets)).join(words, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        self.asked = written(asked.join(df.withColumn("idf", idf(index.n)), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")))
        self.rows = index.rows.where(F.col("bucket").isin(buckets))
        heads = self.rows.select("seq", "term", "block", "most_tf", "least_len").join(self.side(self.asked), "term")
        most = F.sum(F.col("weight") * _share(index.params, index.avgdl, "most_tf", "least_len"))
        bounds = heads.groupBy("query_id", "seq", "block").agg(most.alias("bound"))
        first = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "seq", "block")
        bounds = written(bounds.withColumn("lead", F.row_number().over(first) <= LEAD))
        self.lead = written(self._scored(bounds.where("lead")))
        # the k-th score so far; a query with fewer hits needs all blocks
        goal = best(self.lead, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("goal"))
        # scores are told apart to nine places
        self.bounds = bounds.join(goal, "query_id", "left").withColumn("needed", F.col("lead") | F.col("goal").isNull() | (F.col("bound") >= F.col("goal") - 1e-8)).drop("goal")

    def _scored(self, blocks: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of all chunks of these blocks."""
        wanted = blocks.select("query_id", "seq", "block")
        # postings are shuffled only if it takes too many rows to say which are wanted
        wanted = F.broadcast(wanted) if wanted.count() <= MOST_BLOCKS else wanted
        pairs = self.rows.join(self.side(self.asked), "term").join(wanted, ["query_id", "seq", "block"])
        rows = pairs.select("query_id", "seq", "weight", F.inline("postings"))
        rows = alive(rows, self.index.gone)
        if self.kept is not None:
            rows = rows.join(self.kept, "chunk_id", "left_semi")
        part = F.col("weight") * _share(self.index.params, self.index.avgdl, "tf", "doc_len")
        return rows.select("query_id", "chunk_id", part.alias("part")).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))

    def hits(self) -> DataFrame:
        more = self._scored(self.bounds.where("needed and not lead"))
        return best(self.lead.unionByName(more), self.k).withColumn("bm25_score", F.col("score"))
