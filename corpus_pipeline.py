"""A corpus pipeline of five stages; each takes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, line_dedup, minhash_dedup, quality
from tessera.llm.queries import WORD_BPE
from tessera.llm.tables import read, written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    field = quality.trained(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, field).where(F.col("score") >= quality.THRESHOLD).select(*DOCUMENT)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs, and of single lines that are long, go; every document stays."""
    out = line_dedup.deduplicated(docs, long_words=line_dedup.LONG_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash_dedup.deduplicated(docs).select(*DOCUMENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark")).select(*DOCUMENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text gives its token ids, what they decode to, and the digests of both."""
    return bpe.encoded(docs.select(*DOCUMENT), WORD_BPE).drop("text")


STAGES = [("quality", quality_classifier), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", encode)]

#: A classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
