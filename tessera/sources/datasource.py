"""Files of text, Markdown and PDF as a Spark data source: ``spark.read.format("documents")``, and as a stream.

A partition is a run of small files, or a range of pages of a large PDF file, so one large file is read by several tasks and many small ones by
few. A file that can't be read is a row with what went wrong in ``error``, and stops no other. Files of unknown kinds are left out, or
rejected where the path itself is one file of such a kind.

    spark.dataSource.register(Documents)
    spark.read.format("documents").option("recursive", "true").load("/data")

Options: ``recursive`` (true), ``encoding`` (utf-8), ``extractor`` (module:name of a function from a file's bytes to its pages, which may be a lazy
sequence; ``pypdf`` unless it is said), ``partitionBytes`` (32 MB). A stream gives every file once for each time of change; a file that
appears with the time of one seen before, or an earlier one, is not seen.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.functions.text import content_hash, document_key
from tessera.sources.loaders import KINDS

SCHEMA = "path string, filename string, file_type string, file_size long, modified_at timestamp, encoding string, page int, total_pages int, text string, error string"
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class File:
    path: str
    size: int
    changed: int  # nanoseconds

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def kind(self) -> str | None:
        return KINDS.get("." + self.name.rsplit(".", 1)[-1].lower()) if "." in self.name else None


@dataclass
class Part(InputPartition):
    """Files, of each of which part ``number`` of ``of`` is read: a range of its pages."""

    files: tuple[File, ...]
    number: int = 0
    of: int = 1


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, recursive: bool = True) -> list[File]:
    """The files below a path, on any file system that Arrow knows."""
    from pyarrow import fs

    system, root = _system(path)
    said = system.get_file_info(root)
    if said.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [said] if said.is_file else system.get_file_info(fs.FileSelector(root, recursive=recursive))
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    files = [File(prefix + f.path, f.size or 0, f.mtime_ns or 0) for f in found if f.is_file]
    if said.is_file and files[0].kind is None:
        raise ValueError(f"{path} is of no kind that is read")
    return sorted((f for f in files if f.kind), key=lambda f: f.path)


def parts(files: Sequence[File], size: int = PARTITION_BYTES) -> list[Part]:
    """Small files together, large PDF files by ranges of pages. A large text file is one document, and one task."""
    out, run, total = [], [], 0
    for f in files:
        if f.kind == "pdf" and f.size > size:
            of = -(-f.size // size)
            out += [Part((f,), k, of) for k in range(of)]
            continue
        if run and total + f.size > size:
            out.append(Part(tuple(run)))
            run, total = [], 0
        run.append(f)
        total += f.size
    return [*out, Part(tuple(run))] if run else out


class PypdfPages(Sequence):
    """The pages of a PDF file, each extracted when it is asked for. Needs the package pypdf."""

    def __init__(self, content: bytes):
        import io

        from pypdf import PdfReader

        self.pages = PdfReader(io.BytesIO(content)).pages

    def __len__(self) -> int:
        return len(self.pages)

    def __getitem__(self, k: int) -> str:
        return self.pages[k].extract_text() or ""


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Reader:
    """What both kinds of reading share."""

    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        if not self.path:
            raise ValueError("the option path is missing")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.size = int(options.get("partitionbytes", options.get("partitionBytes", str(PARTITION_BYTES))))
        self.encodings = (options.get("encoding", "utf-8"), "utf-8", "utf-8-sig", "latin-1", "cp1252")
        self.extractor = options.get("extractor", f"{__name__}:PypdfPages")

    def read(self, part: Part) -> Iterator[tuple]:
        for f in part.files:
            head = (f.path, f.name, f.name.rsplit(".", 1)[-1].lower() if f.kind == "text" else f.kind, f.size, datetime.fromtimestamp(f.changed / 1e9, timezone.utc))
            try:
                system, at = _system(f.path)
                with system.open_input_stream(at) as s:
                    content = s.read()
                for encoding, page, total, text in self._pages(content, part) if f.kind == "pdf" else self._decoded(content):
                    yield (*head, encoding, page, total, text, None)
            except Exception as e:  # whatever a file or an extractor may raise
                if part.number == 0:
                    yield (*head, None, None, None, None, f"{type(e).__name__}: {e}")

    def _decoded(self, content: bytes) -> Iterator[tuple]:
        for name in self.encodings:
            try:
                text = content.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
            yield name, None, None, text.replace("\r\n", "\n").replace("\r", "\n")
            return
        raise ValueError("no encoding fits")

    def _pages(self, content: bytes, part: Part) -> Iterator[tuple]:
        pages = _named(self.extractor)(content)
        total = len(pages)
        for k in range(total * part.number // part.of, total * (part.number + 1) // part.of):
            if (text := pages[k]).strip():
                yield None, k + 1, total, text


class Batch(Reader, DataSourceReader):
    def partitions(self) -> list[Part]:
        return parts(listed(self.path, self.recursive), self.size)


class Stream(Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((f.changed for f in listed(self.path, self.recursive)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts([f for f in listed(self.path, self.recursive) if start["changed"] < f.changed <= end["changed"]], self.size)

    def commit(self, end: dict) -> None:
        pass


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)


def documents(rows: DataFrame) -> DataFrame:
    """The rows that could be read as documents, with doc_id and doc_hash; what could not be is where ``error`` is not null."""
    rows = rows.where("error is null").drop("error")
    return rows.select(document_key("path", "text").alias("doc_id"), content_hash("path", "text").alias("doc_hash"), F.col("path").alias("source"), *(c for c in rows.columns if c != "path"))
