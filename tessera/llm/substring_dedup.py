"""Substring dedup with sliding spans of sentences.

A text is cut into sentences: what ends with full stops, question or exclamation marks or
newlines, with the blanks after them. From every sentence on, the run of SPAN consecutive
sentences is hashed, or of as few as have LONG_WORDS words together; a text of fewer
than SPAN sentences is one span. Spans of fewer than LEAST_WORDS words are left
alone. The spans are joined globally, and of each that recurs all but the first copy, by
(doc_id, sentence), have their sentences removed.

Sentences compare lower-cased and without the marks and white space around them. Null
texts stay null, without sentences. Rows that repeat a doc_id are told apart by their
texts; rows equal in both are one document. A row without a doc_id keeps its text. Other columns pass
through `deduplicated`, whatever their names; n_sentences and n_removed are added or replaced. An empty table gives an
empty result. The join on spans has one row a span on one side, so that Spark can split a span with very many copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runs import covered, merged, outside
from tessera.llm.tables import free, written

SPAN = 3
LONG_WORDS = 25
LEAST_WORDS = 8
#: Every character of a text is in one match.
SENTENCE = r"[^.!?\n]+[.!?\n]*[ \t]*|[.!?\n]+[ \t]*"


def sentences(text: Column | str = "text") -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(SENTENCE), F.lit(0))


def _compared(sentence: Column) -> Column:
    return F.lower(F.btrim(sentence, F.lit(" \t\n.!?")))


def _words(compared: Column) -> Column:
    return F.when(compared == "", 0).otherwise(F.length(compared) - F.length(F.replace(compared, F.lit(" "), F.lit(""))) + 1)


def spans(docs: DataFrame, span: int = SPAN, long_words: int = LONG_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, copy, from, until, h1, h2): a row for each span of each text."""
    rows = docs.select("doc_id", "copy", F.transform(sentences(), _compared).alias("s"))
    rows = rows.withColumn("w", F.transform("s", _words))
    count = lambda i, k: F.slice("w", i + 1, F.lit(k))
    total = lambda i, k: F.aggregate(count(i, k), F.lit(0), lambda a, x: a + x)
    n = F.size("s")

    def size(i: Column) -> Column:
        out = F.when((i + span <= n) | (i == 0), F.least(F.lit(span), n - i)).otherwise(0)
        for k in range(span - 1, 0, -1):
            out = F.when((i + k <= n) & (total(i, k) >= long_words), k).otherwise(out)
        return out

    # F.sequence counts down if its end is below its start
    every = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("from"), size(i).alias("k")))
    rows = rows.select("doc_id", "copy", "s", "w", F.explode(every).alias("x")).where("x.k > 0")
    text = F.slice("s", F.col("x.from") + 1, F.col("x.k"))
    words = F.aggregate(F.slice("w", F.col("x.from") + 1, F.col("x.k")), F.lit(0), lambda a, x: a + x)
    rows = rows.where(words >= least_words)
    return rows.select("doc_id", "copy", F.col("x.from").alias("from"), (F.col("x.from") + F.col("x.k")).alias("until"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))


def removals(docs: DataFrame, span: int = SPAN, long_words: int = LONG_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, copy, runs): the merged runs of sentences that a later copy of some span covers."""
    every = written(spans(docs, span, long_words, least_words), "spans")
    at = F.struct("doc_id", "copy", "from")
    first = every.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").drop("last")
    later = every.join(first, ["h1", "h2"]).where(at != F.col("first"))
    return later.groupBy("doc_id", "copy").agg(merged(F.collect_list(F.struct("from", "until"))).alias("runs"))


def deduplicated(docs: DataFrame, span: int = SPAN, long_words: int = LONG_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated spans removed from `text`, and n_sentences, n_removed."""
    text = F.col("text").cast("string")
    keyed = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"))
    rows = docs.drop("n_sentences", "n_removed")
    id_, copy, runs, s = free(rows, "id", "copy", "runs", "s")
    gone = removals(keyed, span, long_words, least_words).select(F.col("doc_id").alias(id_), F.col("copy").alias(copy), F.col("runs").alias(runs))
    out = rows.join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(text) == F.col(copy)), "left").withColumn(s, sentences(text))
    out = out.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(outside(s, runs), "")))
    out = out.withColumn("n_sentences", F.coalesce(F.size(s), F.lit(0)).cast("long")).withColumn("n_removed", covered(runs))
    return out.drop(id_, copy, runs, s)
