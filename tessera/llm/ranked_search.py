"""Ranked lexical search for whole tables of queries by norm buckets.

A document's impact on a term is the term's weight times a damped share of its occurrences; its vector holds its impacts on
all terms that any item asks for, and its score for an item is their sum over the item's terms. Vectors are dealt and
sorted by length, longest first (equal lengths by row, so that a group of copies is dealt out too), and each run of BUCKET of
them is a bucket. For each item, a bucket is passed over

* by Cauchy-Schwarz, if the longest vector times the root of the number of terms can't reach the item's k-th score so far; then no
  later bucket of the task can either;
* by coordinates, if the largest impacts in the bucket on the item's terms, together, can't reach it.

Inside a bucket the terms with the smallest largest impacts that can't reach it together are set aside: only documents that
hold another one are candidates. A candidate whose impacts on the other terms, with what its rest can add at most (by
coordinates, and by Cauchy-Schwarz on what is left of its length), can't reach it is dropped. Survivors are scored exactly in 64-bit
integers. Bounds are doubles, widened by a billionth. Every item's k-th score starts from that over the LEAD longest vectors.

Texts are read once for each block of items (BLOCK_BYTES of text), words being told by hash and then letter by letter; what a task
holds besides is the block's terms, one bucket, and k hits an item.

Null and empty texts have no terms: they count in nothing and are never hits. Rows that repeat are documents of their own, also under
one doc_id. Rows of one item_id (also null) are one item, which asks for the terms of all of them. A null doc_id comes first
among equal scores. Other columns are ignored. Without documents, or items, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.tables import written
from tessera.llm.textops import ALNUM, LOWER, Words, pieces

K = 50
BUCKET = 1024
LEAD = 2048
BLOCK_BYTES = 4 << 20
#: Bounds are widened by this share of themselves, so that rounding can't drop a hit.
SLACK = 1e-9

COUNTED = "row long, doc_id long, n long, terms array<int>, times array<int>"
VECTORS = "row long, doc_id long, length double, terms array<int>, impacts array<long>"


@dataclass
class Asked:
    """A block of items: their ids, their terms (numbers, those of item i from ``first[i]`` on), and the terms by hash, with their letters."""

    ids: pa.Array
    first: np.ndarray
    terms: np.ndarray
    hashes: np.ndarray
    letters: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, texts: list[list[str]]) -> Asked:
        """``texts`` of each of ``ids``."""
        named: dict[bytes, int] = {}
        own: list[set[bytes]] = [set() for _ in texts]
        flat, whose = [t for ts in texts for t in ts], [i for i, ts in enumerate(texts) for _ in ts]
        for row, _, data, offsets in pieces(pa.array(flat, pa.string())):
            w = Words(data, offsets, ALNUM)
            lower = LOWER[data].tobytes()
            of_row = np.searchsorted(w.first, np.arange(len(w.start)), side="right") - 1
            for r, a, b, h in zip(of_row.tolist(), w.start.tolist(), w.end.tolist(), w.hash.tolist(), strict=True):
                named[lower[a:b]] = h
                own[whose[row + r]].add(lower[a:b])
        order = sorted(named, key=lambda t: (named[t], t))
        number = {t: k for k, t in enumerate(order)}
        return cls(
            ids, np.cumsum([0, *map(len, own)]), np.array([number[t] for ts in own for t in sorted(ts)], dtype=np.int64), np.array([named[t] for t in order], dtype=np.uint64),
            np.frombuffer(b"".join(order), np.uint8), np.cumsum([0, *map(len, order)]),
        )

    def numbers(self, w: Words, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of all words that are terms, letter by letter."""
        low, high = np.searchsorted(self.hashes, w.hash, side="left"), np.searchsorted(self.hashes, w.hash, side="right")
        out = []
        for k in range(int((high - low).max(initial=0))):  # once, unless two terms have one hash
            word = np.flatnonzero(low + k < high)
            term = low[word] + k
            size = w.end[word] - w.start[word]
            alike = size == self.at[term + 1] - self.at[term]
            word, term, size = word[alike], term[alike], size[alike]
            if not len(word):
                continue
            begins = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(begins, size)
            other = lower[np.repeat(w.start[word], size) + step] != self.letters[np.repeat(self.at[term], size) + step]
            same = np.add.reduceat(other.astype(np.int32), begins) == 0
            out.append((word[same], term[same]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Asked]]:
    """How many blocks the items make, by the checked size of all, and the blocks, each fetched when it is asked for."""
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count, kind = int(total // block_bytes) + 1, to_arrow_type(rows.schema["item_id"].dataType)

    def each() -> Iterator[Asked]:
        for k in range(count):
            part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k)
            texts: dict = {}
            for r in part.collect():
                texts.setdefault(r.item_id, []).append(r.text)
            yield Asked.of(pa.array(list(texts), kind), list(texts.values()))

    return count, each()


def counted(docs: DataFrame, asked: Asked) -> DataFrame:
    """COUNTED, written: of every document how many terms it has, and how often each that is asked for. ``row`` is its partition's number and its own there."""
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, at = sent.value, TaskContext.get().partitionId() << 32
        width = max(len(asked.hashes), 1)
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                word, term = asked.numbers(w, LOWER[data])
                doc = np.searchsorted(w.first, word, side="right") - 1
                keys, times = np.unique(doc * width + term, return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(end - row + 1) * width).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % width, times)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + end - row)), batch.column("doc_id").slice(row, end - row), pa.array(np.diff(w.first).astype(np.int64)), *lists], names=["row", "doc_id", "n", "terms", "times"])
                at += end - row

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, COUNTED), "counted")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and where each list begins (one more at the end)."""
    return column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets, dtype=np.int64) - column.offsets[0].as_py()


def damped(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def vectors(made: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """VECTORS of COUNTED, written: the documents that hold any of the terms."""
    sent = made.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            wide = n.astype(object) if 50 * int(n.max()) * n_docs >= 1 << 63 else n  # products beyond 64 bits
            m = 50 + ((50 * wide * n_docs) // n_terms).astype(np.int64)
            terms, first = _flat(batch.column("terms"))
            times, _ = _flat(batch.column("times"))
            impacts = weight[terms] * damped(times.astype(np.int64), np.repeat(m, np.diff(first)))
            length = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, first[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(length), batch.column("terms"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(impacts))], names=["row", "doc_id", "length", "terms", "impacts"])

    return written(made.where("size(terms) > 0").mapInArrow(run, VECTORS), "vectors")


class Hits:
    """The best k documents of each item so far: scores, ids and whether those are null."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(float)
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * items

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate([x, y]) for x, y in zip(self.held[item], (score, ids, null), strict=True))
        order = np.lexsort((ids, ~null, -score))[: self.k]
        self.held[item] = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], float(score[order[-1]]))


class Bucket:
    """Vectors of like length, by term."""

    def __init__(self, batch: pa.RecordBatch):
        terms, first = _flat(batch.column("terms"))
        impacts, _ = _flat(batch.column("impacts"))
        self.length = batch.column("length").to_numpy()
        ids = batch.column("doc_id")
        self.null, self.ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
        self.most_terms = int(np.diff(first).max(initial=0))
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = np.repeat(np.arange(len(self.length)), np.diff(first))[order], impacts[order]
        self.terms, begins = np.unique(terms[order], return_index=True)
        self.begin = np.append(begins, len(order))
        self.largest = np.maximum.reduceat(self.impact, begins).astype(float) if len(order) else np.zeros(0)

    def rows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, impact) of all entries of the terms at these places."""
        parts = [np.arange(self.begin[p], self.begin[p + 1]) for p in places.tolist()]
        at = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return self.doc[at], self.impact[at]

    def exact(self, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The scores of ``docs`` over the terms at these places, in integers."""
        own = np.full(len(self.length), -1)
        own[docs] = np.arange(len(docs))
        doc, impact = self.rows(places)
        total = np.zeros(len(docs), dtype=np.int64)
        inside = own[doc] >= 0
        np.add.at(total, own[doc[inside]], impact[inside])
        return total

    def survivors(self, places: np.ndarray, least: float) -> np.ndarray:
        """Documents that may score ``least``, which is above 0, by bounds of their coordinates and lengths."""
        places = places[np.argsort(self.largest[places], kind="stable")]
        aside = int(np.searchsorted(np.cumsum(self.largest[places]) * (1 + SLACK), least))
        rest = self.largest[places[:aside]].sum()
        doc, impact = self.rows(places[aside:])
        impact = impact.astype(float)
        part = np.bincount(doc, weights=impact, minlength=len(self.length))
        square = np.bincount(doc, weights=impact * impact, minlength=len(self.length))
        left = np.sqrt(aside * np.maximum(self.length**2 * (1 + SLACK) - square, 0))
        bound = (part + np.minimum(rest, left)) * (1 + SLACK)
        return np.flatnonzero((part > 0) & (bound >= least))


def scored(rows: DataFrame, asked: Asked, kind: str, k: int, least: np.ndarray) -> DataFrame:
    """item_id (of this ``kind``), doc_id, score: each task's best ``k`` of VECTORS, in which the longest come first, that score ``least`` or more."""
    sent = rows.sparkSession.sparkContext.broadcast((asked, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = sent.value
        hits, sizes = Hits(len(asked.ids), k, least), np.diff(asked.first)
        active, place = np.flatnonzero(sizes), np.full(len(asked.hashes), -1)
        for whole in batches:
            for at in range(0, whole.num_rows if len(active) else 0, BUCKET):
                bucket = Bucket(whole.slice(at, BUCKET))
                longest = bucket.length.max() * (1 + SLACK)
                # what follows is no longer, but may have more terms: an item is done by its own number of terms
                active = active[np.sqrt(sizes[active]) * longest >= hits.least[active]]
                here = active[np.sqrt(np.minimum(sizes[active], bucket.most_terms)) * longest >= hits.least[active]]
                place[bucket.terms] = np.arange(len(bucket.terms))
                for i in here.tolist():
                    places = place[asked.terms[asked.first[i] : asked.first[i + 1]]]
                    places = places[places >= 0]
                    goal = max(hits.least[i], 1.0)
                    if bucket.largest[places].sum() * (1 + SLACK) < goal:
                        continue
                    docs = bucket.survivors(places, goal)
                    score = bucket.exact(places, docs)
                    good = score >= goal
                    if good.any():
                        hits.add(i, score[good], bucket.ids[docs[good]], bucket.null[docs[good]])
                place[bucket.terms] = -1
        for i, (score, ids, null) in enumerate(hits.held):
            if len(score):
                item = asked.ids.take(pa.array(np.full(len(score), i)))
                yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block_hits(docs: DataFrame, asked: Asked, kind: str, k: int) -> DataFrame:
    made = counted(docs, asked)
    n_docs, n_terms = made.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(asked.hashes), dtype=np.int64)
    for r in made.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # of the block's terms
        df[r.term] = r["count"]
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    rows = vectors(made, weight, n_docs, max(n_terms, 1))
    order = [F.col("length").desc(), F.col("row")]
    # the k-th score over the longest vectors; items that have no k hits there begin at 0
    first = best(scored(rows.orderBy(*order).limit(LEAD), asked, kind, k, np.zeros(len(asked.ids))), k).where(F.col("rank") == k)
    number = {x: i for i, x in enumerate(asked.ids.to_pylist())}
    least = np.zeros(len(asked.ids))
    for r in first.select("item_id", "score").collect():
        least[number[r.item_id]] = r.score
    return scored(rows.repartitionByRange(*order).sortWithinPartitions(*order), asked, kind, k, least)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``k`` of ``docs`` (doc_id, text) for each of ``items`` (item_id, text) that score above 0; equal scores by doc_id."""
    kind = items.schema["item_id"].dataType.simpleString()
    count, blocks = item_blocks(items, block_bytes)
    found = [_block_hits(docs, asked, kind, k) for asked in blocks] if count == 1 else [written(best(_block_hits(docs, asked, kind, k), k), "hits") for asked in blocks]
    return best(reduce(DataFrame.unionByName, found), k)
