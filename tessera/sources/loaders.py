"""Files as documents (doc_id, text, source, filename, file_type, file_size, modified_at, encoding, page, total_pages)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, document_key

# Which loader reads which extension.
KINDS = {".txt": "text", ".py": "text", ".json": "text", ".csv": "text", ".md": "markdown", ".markdown": "markdown", ".pdf": "pdf"}

LISTS = ("relevant_doc_names", "relevant_chunk_ids", "relevant_keywords")
Pages = Callable[[bytes], list[str]]
SAMPLES = "name string, description string, samples array<struct<query: string, relevant_doc_names: array<string>, relevant_chunk_ids: array<string>, relevant_keywords: array<string>, ground_truth_answer: string, metadata: map<string, string>>>"


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)


def extension(path: Column | str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _decoded(content: pd.Series, encodings: Sequence[str]) -> pd.DataFrame:
    out = []
    for data in content:
        for name in encodings:
            try:
                text = bytes(data).decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
            out.append((text.replace("\r\n", "\n").replace("\r", "\n"), name))
            break
        else:
            out.append((None, None))
    return pd.DataFrame(out, columns=["text", "encoding"])


def _named(rows: DataFrame) -> DataFrame:
    """What the documents of all loaders have; text files have no pages."""
    return rows.select(
        document_key("path", "text").alias("doc_id"), content_hash("path", "text").alias("doc_hash"), "text", F.regexp_replace("path", "^file:/*", "/").alias("source"), F.element_at(F.split("path", "/"), -1).alias("filename"),
        "file_type", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "encoding", "page", "total_pages",
    )


def text_documents(found: DataFrame, encoding: str = "utf-8", file_type: str = "text") -> DataFrame:
    """One document a file, in the first of some encodings that fits; newlines become ``\\n``."""
    encodings = [encoding, "utf-8", "utf-8-sig", "latin-1", "cp1252"]

    @F.pandas_udf("text string, encoding string")
    def decode(content: pd.Series) -> pd.DataFrame:
        return _decoded(content, encodings)

    rows = found.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).withColumn("_d", decode("content"))
    kind = F.lit("markdown") if file_type == "markdown" else F.ltrim(extension(), F.lit(".")) if file_type == "text" else F.lit(file_type)
    return _named(rows.select("path", "length", "modificationTime", "_d.text", "_d.encoding", kind.alias("file_type"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("total_pages")))


def markdown_documents(found: DataFrame) -> DataFrame:
    return text_documents(found, file_type="markdown")


def pypdf_pages(content: bytes) -> list[str]:
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF files needs the package pypdf on the executors") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def _extracted(found: DataFrame, pages: Pages) -> DataFrame:
    """Files with the texts of their pages in `p`, or with what went wrong in `error`: one broken file stops no other."""

    @F.pandas_udf("p array<string>, error string")
    def read(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                out.append((list(pages(bytes(data))), None))
            except ImportError:
                raise
            except Exception as e:  # whatever the extractor may raise
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["p", "error"])

    return found.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).withColumn("_d", read("content")).select("path", "length", "modificationTime", "_d.*")


def pdf_documents(found: DataFrame, pages: Pages = pypdf_pages) -> DataFrame:
    """One document a page that is not blank; files that can't be read are left out (`pdf_failures`)."""
    rows = _extracted(found, pages).where("error is null")
    rows = rows.select("path", "length", "modificationTime", F.size("p").alias("total_pages"), F.posexplode("p").alias("_k", "text")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return _named(rows.withColumn("page", F.col("_k") + 1).withColumn("file_type", F.lit("pdf")).withColumn("encoding", F.lit(None).cast("string")))


def pdf_failures(found: DataFrame, pages: Pages = pypdf_pages) -> DataFrame:
    """(path, error) of the files that can't be read."""
    return _extracted(found, pages).where("error is not null").select("path", "error")


def directory_documents(spark: SparkSession, path: str, recursive: bool = True, extensions: Iterable[str] | None = None, pages: Pages = pypdf_pages) -> tuple[DataFrame, DataFrame]:
    """The documents of a folder, and the files (path, error) that could not be read. Files of unknown kinds are left out."""
    wanted = set(KINDS) if extensions is None else {e if e.startswith(".") else f".{e}" for e in map(str.lower, extensions)} & set(KINDS)
    found = files(spark, path, recursive).where(extension().isin(sorted(wanted)) if wanted else F.lit(False))
    of = lambda kind: found.where(extension().isin([e for e, k in KINDS.items() if k == kind]))
    docs = text_documents(of("text")).unionByName(markdown_documents(of("markdown")))
    failed = docs.where("text is null").select(F.col("source").alias("path"), F.lit("no encoding fits").alias("error"))
    docs = docs.where("text is not null")
    if ".pdf" in wanted:
        docs, failed = docs.unionByName(pdf_documents(of("pdf"), pages)), failed.unionByName(pdf_failures(of("pdf"), pages))
    return docs, failed


def file_documents(spark: SparkSession, path: str, pages: Pages = pypdf_pages) -> DataFrame:
    """One file, by its extension; unknown ones are text."""
    found = files(spark, path)
    kind = next((k for e, k in KINDS.items() if path.lower().endswith(e)), "text")
    return pdf_documents(found, pages) if kind == "pdf" else text_documents(found, file_type=kind)


def texts(spark: SparkSession, given: Sequence[str], metadatas: Sequence[Mapping[str, Any]] | None = None) -> DataFrame:
    """A small list of texts with their metadata; without any, the source is ``text_<i>``."""
    import json

    rows = [(t, json.dumps(dict(metadatas[i])) if metadatas else json.dumps({"source": f"text_{i}"})) for i, t in enumerate(given)]
    df = spark.createDataFrame(rows, "text string, metadata string").withColumn("metadata", F.parse_json("metadata"))
    return from_table(df.withColumn("source", F.try_variant_get("metadata", "$.source", "string")))


def from_table(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Any table with a text column as documents; doc_id is made of source and text unless there is one."""
    src = F.col(source).cast("string") if source in df.columns else F.lit("")
    rows = df.withColumn("source", src).withColumn("text", F.col(text))
    rows = rows if "doc_id" in df.columns else rows.withColumn("doc_id", document_key("source", "text"))
    return rows.withColumn("doc_hash", content_hash("source", "text"))


@dataclass
class Dataset:
    """Labelled queries: `samples` (query_id, text, relevant_doc_names, relevant_chunk_ids, relevant_keywords, ground_truth_answer, metadata)."""

    name: str
    description: str
    samples: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dataset:
        """From a JSON file (or a folder with one); what is missing is empty, and query_id is the place in the file."""
        whole = spark.read.schema(SAMPLES).option("multiLine", True).json(path)
        head = whole.select("name", "description").first()
        rows = whole.select(F.posexplode("samples").alias("query_id", "s"))
        empty = F.array().cast("array<string>")
        lists = (F.coalesce(f"s.{c}", empty).alias(c) for c in LISTS)
        metadata = F.coalesce("s.metadata", F.create_map().cast("map<string,string>")).alias("metadata")
        samples = rows.select(F.col("query_id").cast("long"), F.col("s.query").alias("text"), *lists, "s.ground_truth_answer", metadata)
        return cls(head.name or "" if head else "", head.description or "" if head else "", samples)

    def add_sample(self, query: str, relevant_doc_names: Sequence[str] = (), relevant_chunk_ids: Sequence[str] = (), relevant_keywords: Sequence[str] = (), ground_truth_answer: str | None = None, metadata: Mapping[str, str] | None = None) -> Dataset:
        """The labelled queries with one more at the end."""
        last = self.samples.agg(F.coalesce(F.max("query_id") + 1, F.lit(0))).first()[0]
        row = (last, query, list(relevant_doc_names), list(relevant_chunk_ids), list(relevant_keywords), ground_truth_answer, dict(metadata or {}))
        return Dataset(self.name, self.description, self.samples.unionByName(self.samples.sparkSession.createDataFrame([row], self.samples.schema)))

    def save(self, path: str) -> None:
        """As one JSON object, which `load` reads: the format is a single record, so all queries meet in one row."""
        sample = F.struct("query_id", F.col("text").alias("query"), *LISTS, "ground_truth_answer", "metadata")
        one = self.samples.agg(F.array_sort(F.collect_list(sample), lambda a, b: F.signum(a["query_id"] - b["query_id"]).cast("int")).alias("samples"))
        one = one.withColumn("samples", F.transform("samples", lambda s: s.dropFields("query_id")))
        one.select(F.lit(self.name).alias("name"), F.lit(self.description).alias("description"), "samples").write.mode("overwrite").json(path)


def evaluation_samples(spark: SparkSession, path: str) -> DataFrame:
    """The labelled queries of a JSON file."""
    return Dataset.load(spark, path).samples
