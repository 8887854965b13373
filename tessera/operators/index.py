"""An index that grows by deltas: every change writes what is new, and a log entry that counts it in."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from itertools import accumulate
from math import floor, log
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import terms
from tessera.operators import chunking, sparse
from tessera.operators.embeddings import Embeddings, ModelEmbeddings, default_embeddings
from tessera.sources.journal import Journal

#: Tables whose rows belong to a document. ``vectors`` has the chunks' other columns too, so that a filtered search joins nothing.
TABLES = ("registry", "chunks", "vectors", "words")
#: How many merges ago a segment that a reader may still hold was replaced, at most.
GENERATIONS = 8
#: Documents that are gone, whose ids are sent to all executors at most: some 100 MB. Beyond that rows are shuffled by document.
MOST_GONE = 1 << 21
#: Letters of a column's least and largest value that are kept with a segment.
BOUND = 64


class Changed(RuntimeError):
    """Another writer has changed the index meanwhile; nothing was done."""


def fresh(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The documents of a batch whose id and content are not known together; of an id that the batch repeats one."""
    return chosen(batch).join(known.select("doc_id", "doc_hash"), ["doc_id", "doc_hash"], "left_anti")


def chosen(batch: DataFrame) -> DataFrame:
    """One row of each doc_id: that with the largest doc_hash."""
    order = Window.partitionBy("doc_id").orderBy(F.col("doc_hash").desc())
    return batch.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def _within(value: Any, bounds: list | None) -> bool:
    """Whether a column with these bounds may have a value; without bounds it may."""
    if bounds is None or value is None:
        return True
    low, high = bounds
    if isinstance(value, str) != isinstance(low, str):
        return True
    value = value[:BOUND] if isinstance(value, str) else value
    return low <= value <= high


@dataclass
class Manager:
    """Keeps chunks, vectors and an inverted index in step with the documents.

    A document whose id and content are known is skipped; one whose id is known is replaced, and goes if its new text gives no chunks. With
    ``replace_by_source`` a document also replaces what its source held before.

    A change is a segment: its own rows of every table, and the doc_ids whose rows in earlier segments are gone. Readers see the segments
    that the latest log entry names, so a change shows as a whole. Corpus statistics and document frequencies are kept by signed
    differences. `merge` makes one segment of neighbours once ``fanout`` of a size (within a power of ``fanout``), or smaller ones before
    them, have come together, so that their number grows with the logarithm of the rows; `compact` makes one of all. Vectors of a model are kept by the
    hash of their text (``keep_embeddings``, of models unless it is said), so that a text that was embedded before, in whatever document, is not embedded
    again. What the scores depend on (BM25's parameters, the metric) is kept with the index; another choice for an index that exists
    is an error.
    """

    spark: SparkSession
    path: str
    embeddings: Embeddings = field(default_factory=default_embeddings)
    chunk: Callable[[DataFrame], DataFrame] = chunking.recursive_chunks
    params: sparse.BM25 | None = None
    metric: str | None = None
    replace_by_source: bool = False
    fanout: int = 8
    keep_embeddings: bool | None = None

    def __post_init__(self) -> None:
        self.journal = Journal(self.spark, self.path)
        said = self.journal.latest()[1].get("params")
        kept = sparse.BM25(said["k1"], said["b"], None if said["stopwords"] is None else tuple(said["stopwords"])) if said else None
        for given, has in ((self.params, kept), (self.metric, said and said["metric"])):
            if has is not None and given is not None and given != has:
                raise ValueError(f"the index at {self.path} was made with {has}, not {given}")
        self.params = kept or self.params or sparse.BM25()
        self.metric = (said and said["metric"]) or self.metric or "cosine"
        if self.keep_embeddings is None:
            self.keep_embeddings = isinstance(self.embeddings, ModelEmbeddings)

    def _state(self) -> tuple[int, dict[str, Any]]:
        version, state = self.journal.latest()
        return version, state or {"segments": [], "schemas": {}, "documents": 0, "chunks": 0, "terms": 0, "replaced": []}

    def version(self) -> int:
        return self.journal.latest()[0]

    def _rows(self, name: str, state: dict[str, Any], segments: list[dict[str, Any]] | None = None) -> DataFrame | None:
        """The rows of a table, with the ``seq`` of their segment."""
        paths = [f"{self.path}/{name}/seq={s['seq']}/run={s['run']}" for s in (state["segments"] if segments is None else segments) if name in s["tables"]]
        if not paths:
            return None
        schema = StructType.fromJson(state["schemas"][name]).add("seq", "long").add("run", "string")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths).drop("run")

    def _gone(self, state: dict[str, Any], segments: list[dict[str, Any]] | None = None) -> DataFrame | None:
        """(doc_id, gone): only rows of segment ``gone`` and later ones count."""
        rows = self._rows("gone", state, segments)
        if rows is None:
            return None
        marks = rows.groupBy("doc_id").agg(F.max("seq").alias("gone"))
        return F.broadcast(marks) if self._few_gone(state["segments"] if segments is None else segments) else marks

    @staticmethod
    def _few_gone(segments: list[dict[str, Any]]) -> bool:
        """Whether the ids of gone documents are sent to all executors; where a segment's log entry doesn't say how many they are, they are shuffled."""
        return sum(s.get("gone", MOST_GONE + 1) for s in segments if "gone" in s["tables"]) <= MOST_GONE

    def _live(self, name: str, state: dict[str, Any], segments: list[dict[str, Any]] | None = None) -> DataFrame | None:
        """The live rows of a table, of all segments or of these."""
        rows = self._rows(name, state, segments)
        if rows is None:
            return None
        if name == "postings":
            return sparse.alive(rows.select("seq", "term", F.inline("postings")), self._gone(state)).drop("seq")
        return sparse.alive(rows, self._gone(state)).select(*(c for c in rows.columns if c != "seq"))

    def table(self, name: str, filters: Mapping[str, Any] | None = None) -> DataFrame | None:
        """The live rows of registry, chunks, vectors, words or postings; None before the first change. Segments that have no row with what
        ``filters`` ask for, by their bounds, are left out; the rows of the others are not filtered."""
        state = self._state()[1]
        return self._live(name, state, self._may_have(state, filters))

    def _may_have(self, state: dict[str, Any], filters: Mapping[str, Any] | None) -> list[dict[str, Any]]:
        """The segments that may have rows with what ``filters`` ask for; if there are none, one for its columns."""
        return self.segments(filters, state) or [s for s in state["segments"] if "vectors" in s["tables"]][:1]

    def segments(self, filters: Mapping[str, Any] | None = None, state: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        """The segments that may have rows with what ``filters`` ask for."""
        return [s for s in (state or self._state()[1])["segments"] if all(_within(v, s.get("bounds", {}).get(c)) for c, v in (filters or {}).items())]

    def _write(self, name: str, df: DataFrame, segment: dict[str, Any], state: dict[str, Any]) -> DataFrame:
        """Writes a table of a segment, and returns it as it was written."""
        path = f"{self.path}/{name}/seq={segment['seq']}/run={segment['run']}"
        by = [c for c in ("bucket",) if c in df.columns]
        df.write.partitionBy(*by).parquet(path)
        segment["tables"].append(name)
        had = StructType.fromJson(state["schemas"][name]) if name in state["schemas"] else StructType()
        more = [f for f in df.schema.fields if f.name not in had.names]
        state["schemas"][name] = StructType(had.fields + more).jsonValue()
        return self.spark.read.schema(df.schema).parquet(path)

    def _work(self, name: str, df: DataFrame, segment: dict[str, Any]) -> DataFrame:
        """A table that a change is made from; goes with `_done`."""
        path = f"{self.path}/work/{segment['run']}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _done(self, segment: dict[str, Any]) -> None:
        self.journal.delete(f"work/{segment['run']}")

    def _publish(self, version: int, state: dict[str, Any]) -> None:
        p = self.params
        state["params"] = {"k1": p.k1, "b": p.b, "stopwords": None if p.stopwords is None else list(p.stopwords), "metric": self.metric}
        state["dimension"] = self.embeddings.dimension
        if not self.journal.advance(version + 1, state):
            raise Changed(self.path)

    def _segment(self, version: int) -> dict[str, Any]:
        return {"seq": version + 1, "run": uuid.uuid4().hex, "tables": [], "rows": 0, "bounds": {}}

    def _replace(self, old: list[dict[str, Any]], state: dict[str, Any]) -> None:
        """Notes segments that no new reader sees, and deletes those that were noted GENERATIONS ago, for readers that are not done."""
        state["replaced"] = [*state["replaced"], old]
        for group in state["replaced"][:-GENERATIONS]:
            for s in group:
                self._drop(s)
        state["replaced"] = state["replaced"][-GENERATIONS:]

    def _leave(self, gone: DataFrame, segment: dict[str, Any], state: dict[str, Any]) -> tuple[int, DataFrame | None]:
        """Writes which documents (rows of the registry) are gone and takes them out of the statistics; their number, and the terms' differences."""
        gone = self._write("gone", gone.select("doc_id", "chunk_count", "terms"), segment, state)
        n, chunks, words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("chunk_count"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        state["documents"], state["chunks"], state["terms"] = state["documents"] - n, state["chunks"] - chunks, state["terms"] - words
        segment["rows"], segment["gone"] = segment["rows"] + n, n
        if not n:
            return 0, None
        # the segment itself is not among those of the state yet
        had = self._live("words", state).join(gone.select("doc_id"), "doc_id", "left_semi")
        return n, had.select(F.inline("words")).select("term", (-F.col("df")).alias("df"))

    def _write_frequencies(self, parts: list[DataFrame], segment: dict[str, Any], state: dict[str, Any]) -> None:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        sums = rows.groupBy(sparse.bucket().alias("bucket"), "term").agg(F.sum("df").alias("df")).where("df <> 0")
        self._write("frequencies", sums.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"), segment, state)

    def index(self) -> sparse.Blocks:
        """The inverted index, for `sparse.search`: a search reads the postings of its terms' folders, and there those of the blocks it needs."""
        state = self._state()[1]
        return sparse.Blocks(self._rows("postings", state), self._rows("frequencies", state).drop("seq"), self._gone(state), state["chunks"], state["terms"] / max(state["chunks"], 1), self.params)

    def index_documents(self, docs: DataFrame, force: bool = False) -> dict[str, int]:
        """Adds documents (doc_id, doc_hash, text, ...). Of an id that a batch repeats one document is taken.

        The batch meets the registry once: what is new or changed is written before anything is made of it. A known document whose new text
        gives no chunks goes, and counts as skipped.
        """
        version, state = self._state()
        if state["segments"] and state["dimension"] != self.embeddings.dimension:
            # vectors of another model are of no use
            self._replace(state["segments"], state)
            state |= {"segments": [], "schemas": {}, "documents": 0, "chunks": 0, "terms": 0}
        known = self._live("registry", state)
        segment, n_batch = self._segment(version), docs.count()
        batch = self._work("batch", chosen(docs) if known is None or force else fresh(docs, known), segment)
        made = self._write("chunks", self.chunk(batch), segment, state)
        own = F.coalesce(terms("content", self.params.stopwords), F.array().cast("array<string>"))
        tokens = self._work("tokens", sparse.forward(made.select("chunk_id", "doc_id", own.alias("tokens")).withColumn("doc_len", F.size("tokens"))), segment)
        counts = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.sum("doc_len").alias("terms"))
        optional = [c for c in ("source", "filename", "modified_at") if c in batch.columns]
        entries = batch.select("doc_id", "doc_hash", *optional).join(counts, "doc_id").withColumn("indexed_at", F.current_timestamp())
        entries = self._write("registry", entries, segment, state)
        n_new, n_chunks, words = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("chunk_count"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        first, n_gone, less = not state["segments"], 0, None
        if known is not None:
            same = known.join(batch.select("doc_id"), "doc_id", "left_semi")
            if self.replace_by_source and "source" in known.columns and "source" in entries.columns:
                same = same.unionByName(known.join(entries.select("source").distinct(), "source", "left_semi")).dropDuplicates(["doc_id"])
            n_gone, less = self._leave(same, segment, state)
        if n_new or n_gone or first:
            segment["rows"] += n_chunks
            self._write_made(made, tokens, less, segment, state)
            state["documents"], state["chunks"], state["terms"] = state["documents"] + n_new, state["chunks"] + n_chunks, state["terms"] + words
            state["segments"].append(segment)
            self._publish(version, state)
        else:
            self._drop(segment)
        self._done(segment)
        return {"indexed_documents": n_new, "skipped_documents": n_batch - n_new, "new_chunks": n_chunks, "total_chunks": state["chunks"], "total_documents": state["documents"]}

    def _write_made(self, made: DataFrame, tokens: DataFrame, less: DataFrame | None, segment: dict[str, Any], state: dict[str, Any]) -> None:
        """The tables that are made of a segment's chunks, and of their terms as `sparse.forward` counts them."""
        beside = [c for c in made.columns if c not in ("chunk_id", "doc_id", "content")]
        vectors = self._write("vectors", self._embedded(made, segment, state).select("chunk_id", "doc_id", "embedding", *beside), segment, state)
        segment["bounds"] = self._bounds(vectors.select(*beside)) if beside else {}
        # a row for each chunk: the differences are summed anyway
        words = F.transform("counts.term", lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("df")))
        self._write("words", tokens.where("doc_len > 0").select("doc_id", words.alias("words")), segment, state)
        flat = tokens.select("chunk_id", "doc_id", "doc_len", F.inline("counts"))
        rows = self._write("postings", sparse.blocked(flat, tokens.select("chunk_id", "doc_len")), segment, state)
        self._write_frequencies([rows.select("term", "df"), *([] if less is None else [less])], segment, state)

    def _embedded(self, made: DataFrame, segment: dict[str, Any], state: dict[str, Any]) -> DataFrame:
        """``made`` with the embedding of its content; only texts that no segment has are given to the model, each once."""
        if not self.keep_embeddings:
            return made.withColumn("embedding", self.embeddings.documents("content"))
        named = made.withColumn("_hash", F.sha2("content", 256))
        texts, known = named.groupBy("_hash").agg(F.first("content").alias("content")), self._rows("embedded", state)
        known = None if known is None else known.drop("seq")
        new = texts if known is None else texts.join(known, "_hash", "left_anti")
        new = self._write("embedded", new.select("_hash", self.embeddings.documents("content").alias("embedding")), segment, state)
        return named.join(new if known is None else known.unionByName(new), "_hash")

    @staticmethod
    def _bounds(rows: DataFrame) -> dict[str, list]:
        """Least and largest value of every column of text or numbers that has no nulls and no NaN."""
        names = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("string", "integer", "long", "double")]
        text = {f.name for f in rows.schema.fields if f.dataType.typeName() == "string"}
        cut = lambda c: F.substring(F.col(c), 1, BOUND) if c in text else F.col(c)
        got = rows.agg(F.count(F.lit(1)).alias("n"), *(x for i, c in enumerate(names) for x in (F.min(cut(c)).alias(f"a{i}"), F.max(cut(c)).alias(f"b{i}"), F.count(c).alias(f"n{i}")))).first()
        return {c: [got[f"a{i}"], got[f"b{i}"]] for i, c in enumerate(names) if got["n"] and got[f"n{i}"] == got["n"] and got[f"b{i}"] == got[f"b{i}"]}

    def delete_documents(self, ids: DataFrame) -> int:
        """Takes out the documents that ``ids`` (doc_id) name; how many there were."""
        version, state = self._state()
        known = self._live("registry", state)
        if known is None:
            return 0
        segment = self._segment(version)
        n, less = self._leave(known.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), segment, state)
        if not n:
            self._drop(segment)
            return 0
        self._write_frequencies([less], segment, state)
        state["segments"].append(segment)
        self._publish(version, state)
        return n

    def delete_document(self, doc_id: Any) -> bool:
        known = self.table("registry")
        return known is not None and self.delete_documents(known.where(F.col("doc_id") == doc_id).select("doc_id")) > 0

    def _drop(self, segment: dict[str, Any]) -> None:
        for name in segment["tables"]:
            self.journal.delete(f"{name}/seq={segment['seq']}/run={segment['run']}")

    def _due(self, segments: list[dict[str, Any]]) -> int | None:
        """From which segment on the last ones are to be one: as soon as ``fanout`` are of a size. One that a larger one follows counts as of
        that size, since no other of its own size can come next to it."""
        sizes = [floor(log(max(s["rows"], 1), self.fanout) + 1e-9) for s in segments]
        sizes = list(accumulate(reversed(sizes), max))[::-1]
        return next((sizes.index(size) for size in sorted(set(sizes)) if sizes.count(size) >= self.fanout), None)

    def merge(self) -> int:
        """Merges segments until none are due; how many merges there were. If another writer comes first, the rest is left for later."""
        done = 0
        while (start := self._due(self._state()[1]["segments"])) is not None:
            try:
                self._merged(start)
            except Changed:
                break
            done += 1
        return done

    def compact(self) -> None:
        """Makes one segment of the live rows."""
        self._merged(0)

    def _merged(self, start: int) -> None:
        """One segment of all from number ``start`` on. Its number is the last one's, so that what it says is gone is gone before it."""
        version, state = self._state()
        old = state["segments"][start:]
        if not old:
            return
        segment = self._segment(version) | {"seq": old[-1]["seq"]}
        for name in TABLES:
            if (rows := self._live(name, state, old)) is not None:
                self._write(name, rows, segment, state)
        if (flat := self._live("postings", state, old)) is not None:
            # read three times: written first only if each time would shuffle it by document
            flat = flat if self._few_gone(state["segments"]) else self._work("postings", flat, segment)
            self._write("postings", sparse.blocked(flat), segment, state)
        if (differences := self._rows("frequencies", state, old)) is not None:
            self._write_frequencies([differences.select("term", "df")], segment, state)
        if (embedded := self._rows("embedded", state, old)) is not None:
            embedded = embedded.drop("seq").dropDuplicates(["_hash"])
            if not start:  # what no chunk has any more goes
                embedded = embedded.join(self._live("chunks", state).select(F.sha2("content", 256).alias("_hash")), "_hash", "left_semi")
            self._write("embedded", embedded, segment, state)
        if start and (gone := self._rows("gone", state, old)) is not None:
            marks = gone.groupBy("doc_id").agg(F.max("chunk_count").alias("chunk_count"), F.max("terms").alias("terms"))
            segment["gone"] = self._write("gone", marks, segment, state).count()
            segment["rows"] += segment["gone"]
        if "vectors" in segment["tables"]:
            rows = self._rows("vectors", state, [segment])
            segment["rows"] += rows.count()
            segment["bounds"] = self._bounds(rows.drop("seq", "chunk_id", "doc_id", "embedding"))
        state["segments"] = [*state["segments"][:start], segment]
        self._replace(old, state)
        try:
            self._publish(version, state)
        except Changed:
            self._drop(segment)
            raise
        finally:
            self._done(segment)

    def stats(self) -> DataFrame:
        """One row, from the log and the vocabulary's differences."""
        state = self._state()[1]
        words = self.index().vocab.count() if state["segments"] else 0
        row = (state["documents"], state["chunks"], self.embeddings.dimension, self.metric, words, round(state["terms"] / max(state["chunks"], 1), 2), self.path)
        return self.spark.createDataFrame([row], "total_documents long, total_chunks long, embedding_dimension int, vector_store_metric string, bm25_vocabulary_size long, bm25_avg_doc_len double, index_directory string")
