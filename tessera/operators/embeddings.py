"""Text to vectors: hashing natively, models through injected encoders."""

from __future__ import annotations

import importlib.util
import warnings
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.batches import runs
from tessera.functions.text import let, word_runs

#: Words, and numbers of vectors, that a task works on at once.
MOST_WORDS = 1 << 18

Encode = Callable[[list[str]], Sequence[Sequence[float]]]


class Embeddings(Protocol):
    dimension: int

    def documents(self, text: Column | str) -> Column: ...

    def queries(self, text: Column | str) -> Column: ...


def normalised(vector: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(vector, lambda v: let(F.when(norm(v) == 0, 1.0).otherwise(norm(v)), lambda n: F.transform(v, lambda x: x / n)))


class HashingEmbeddings:
    """Counts of words by crc32 bucket, of unit length; a text without words is the zero vector."""

    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def documents(self, text: Column | str) -> Column:
        dimension = self.dimension

        @F.pandas_udf("array<float>")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            # one pass over the words of many texts, whatever the dimension
            for buckets in batches:
                every = [b if b is not None else () for b in buckets]
                at = np.concatenate([[0], np.cumsum([len(b) for b in every], dtype=np.int64)])
                for first, end in runs(at, MOST_WORDS, max(1, MOST_WORDS // dimension)):
                    rows, size = every[first:end], np.diff(at[first : end + 1])
                    flat = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
                    place = np.repeat(np.arange(len(rows)), size) * dimension + flat
                    counts = np.bincount(place, minlength=len(rows) * dimension).reshape(len(rows), dimension)
                    norm = np.sqrt((counts * counts).sum(axis=1))
                    yield pd.Series(list((counts / np.where(norm == 0, 1, norm)[:, None]).astype(np.float32)), dtype=object)

        return counted(F.transform(word_runs(text), lambda w: (F.crc32(w.cast("binary")) % dimension).cast("int")))

    queries = documents


class ModelEmbeddings:
    """A model per Python worker: ``load`` makes an encoder of lists of texts; document and query encoders may differ."""

    def __init__(self, load: Callable[[], Encode], dimension: int, load_query: Callable[[], Encode] | None = None, normalise: bool = True):
        self.load, self.dimension, self.load_query, self.normalise = load, dimension, load_query or load, normalise

    def _column(self, load: Callable[[], Encode], text: Column | str) -> Column:
        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())])

        out = encode(text)
        return F.transform(normalised(F.transform(out, lambda x: x.cast("double"))), lambda x: x.cast("float")) if self.normalise else out

    def documents(self, text: Column | str) -> Column:
        return self._column(self.load, text)

    def queries(self, text: Column | str) -> Column:
        return self._column(self.load_query, text)


def default_embeddings() -> Embeddings:
    """A sentence transformer where its package is installed, else hashing, with a warning."""
    if importlib.util.find_spec("sentence_transformers"):
        return sentence_transformer()
    warnings.warn("sentence-transformers is not installed; texts are embedded by hashing their words", stacklevel=3)
    return HashingEmbeddings()


def sentence_transformer(name: str = "all-MiniLM-L6-v2", device: str | None = None) -> ModelEmbeddings:
    """Needs the sentence-transformers package on the executors."""

    def load() -> Encode:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, device=device)
        return lambda texts: model.encode(texts, normalize_embeddings=True)

    return ModelEmbeddings(load, 384)


def hosted(name: str = "models/text-embedding-004", api_key: str | None = None, dimension: int = 768) -> ModelEmbeddings:
    """Embeddings of a hosted model, one call a text; needs the google-generativeai package and a network."""

    def loader(task: str) -> Callable[[], Encode]:
        def load() -> Encode:
            import google.generativeai as client

            client.configure(api_key=api_key)
            return lambda texts: [client.embed_content(model=name, content=t, task_type=task)["embedding"] for t in texts]

        return load

    return ModelEmbeddings(loader("retrieval_document"), dimension, loader("retrieval_query"))
