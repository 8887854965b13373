"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad; its features are what its bytes and words look like, and
the same of the line before and the line after. The labels of documents are the labels
of their lines. The field is fitted by gradient steps on the log-likelihood of a bounded
sample of labelled documents; forward-backward gives each line's marginal, and
a document's score is the mean of its lines' marginals, weighted by length.

Null and empty texts, which have no lines, score the share of good documents in the
sample. Rows that repeat stay, each with its score. Only the text enters a score.
Labels of unknown documents and null labels are ignored, and so are those of a doc_id with labels
of both kinds; without any label of both kinds every score is that share (or a half).
Of a doc_id with several texts each is fitted. Other columns pass through, whatever their names;
one named score is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.textops import UNSPACED, Words, byte_class, pieces

#: Documents that are fitted on at most; which, a hash of the id decides.
MOST_DOCUMENTS = 1600
#: Lines of one fitted document at most; of longer ones runs of this length are fitted as documents of their own.
MOST_LINES = 60
#: Documents of one batch of a step.
BATCH = 512
#: Such runs of one fitted document at most, evenly spaced; all lines count where documents are scored.
MOST_RUNS = 8
STEPS = 120
THRESHOLD = 0.3

_UPPER = byte_class(lambda b: 0x41 <= b <= 0x5A)
_LOWER = byte_class(lambda b: 0x61 <= b <= 0x7A)
_DIGIT = byte_class(lambda b: 0x30 <= b <= 0x39)
_HIGH = byte_class(lambda b: b >= 0x80)
_END = byte_class(lambda b: b in b".!?")
_COMMA = byte_class(lambda b: b in b",;:")
_BANG = byte_class(lambda b: b in b"!?")
_SYMBOL = byte_class(lambda b: 0x21 <= b <= 0x7E and not (chr(b).isalnum() or chr(b) in ".,;:!?'\"()-"))
_CLASSES = (_UPPER, _LOWER, _DIGIT, _HIGH, _END, _COMMA, _BANG, _SYMBOL)
N_OWN = 18
N_FEATURES = 3 * N_OWN + 2


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, first line of each text and one more) of the lines of some texts; blank lines count."""
    n = len(data)
    breaks = np.flatnonzero(data == 0x0A)
    full = offsets[1:] > offsets[:-1]
    starts = np.unique(np.concatenate([offsets[:-1][full], breaks + 1]))
    # a break that ends its text opens no line
    starts = starts[starts < n]
    starts = starts[(data[starts] != 0x0A) | np.isin(starts, offsets) | (data[np.maximum(starts - 1, 0)] == 0x0A)]
    ends = np.append(starts[1:], n)
    length = ends - starts
    m = len(starts)
    own = np.zeros((m, N_OWN))
    if m:
        size = np.maximum(length, 1)
        for k, chars in enumerate(_CLASSES):
            own[:, k] = np.add.reduceat(chars[data].astype(np.int32), starts) / size
        w = Words(data, offsets, UNSPACED)
        line = np.searchsorted(starts, w.start, side="right") - 1
        count = np.bincount(line, minlength=m)
        words = np.maximum(count, 1)
        letters = w.end - w.start
        own[:, 8] = np.log1p(length)
        own[:, 9] = np.log1p(count)
        own[:, 10] = np.bincount(line, letters, minlength=m) / words / 10
        own[:, 11] = np.bincount(line, letters == 1, minlength=m) / words
        own[:, 12] = np.bincount(line, letters > 20, minlength=m) / words
        same = np.zeros(len(w.hash), dtype=bool)  # as the word before
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
        own[:, 13] = np.bincount(line, same, minlength=m) / words
        if len(w.hash):
            order = np.lexsort((w.hash, line))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (line[order][1:] != line[order][:-1])
            own[:, 14] = np.bincount(line[order], fresh, minlength=m) / words
        own[:, 15] = _END[data[np.maximum(ends - 2, starts)]] | _END[data[ends - 1]]
        own[:, 16] = _UPPER[data[starts]]
        own[:, 17] = 1 - np.exp(-length / 40)
    first = np.searchsorted(starts, offsets)
    out = np.zeros((m, N_FEATURES))
    out[:, :N_OWN] = own
    at = np.arange(m)
    has_before, has_after = ~np.isin(at, first[:-1]), ~np.isin(at + 1, first)
    out[1:, N_OWN : 2 * N_OWN] = own[:-1] * has_before[1:, None]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:] * has_after[:-1, None]
    out[:, -2], out[:, -1] = has_before, has_after
    return out, length, first


@dataclass
class Field:
    """Weights: of the features for good against bad (with the bias last), of the four transitions, of the two starts."""

    weight: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def unary(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1]


def forward_backward(unary: np.ndarray, length: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good (documents x lines), sums of pair marginals (documents x 2 x 2), log partition sums, for padded rows."""
    docs, lines = unary.shape
    emit = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha = np.empty((docs, lines, 2))
    beta = np.zeros((docs, lines, 2))
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, lines):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + emit[:, t]
    for t in range(lines - 2, -1, -1):
        ahead = beta[:, t + 1] + emit[:, t + 1]
        b = np.logaddexp(ahead[:, 0, None] + moves[:, 0], ahead[:, 1, None] + moves[:, 1])
        beta[:, t] = np.where((t + 1 < length)[:, None], b, 0)
    end = alpha[np.arange(docs), length - 1]
    z = np.logaddexp(end[:, 0], end[:, 1])
    good = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0))
    pairs = np.zeros((docs, 2, 2))
    if lines > 1:
        inside = (np.arange(1, lines)[None] < length[:, None])[:, :, None, None]
        p = alpha[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]
        pairs = np.where(inside, np.exp(np.minimum(p, 0)), 0).sum(axis=1)
    return good, pairs, z


def padded(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different lengths, filled up with zeros; the lengths."""
    length = np.diff(first)
    out = np.zeros((len(length), max(1, int(length.max(initial=1)))))
    out[np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(first[:-1], length)] = values
    return out, length


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS, decay: float = 1e-3, prior: float | None = None) -> Field:
    """Fits a field to documents whose lines all have the document's label."""
    prior = float(label.mean()) if prior is None and len(label) else (0.5 if prior is None else prior)
    mean, scale = (features.mean(axis=0), features.std(axis=0) + 1e-6) if len(features) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    x = (features - mean) / scale
    length = np.diff(first)
    label = label.astype(float)
    weight, moves, start = np.zeros(N_FEATURES + 1), np.zeros((2, 2)), np.zeros(2)
    state = [np.zeros(N_FEATURES + 7), np.zeros(N_FEATURES + 7)]
    good_docs = max(1.0, label.sum())
    share = np.where(label > 0, 0.5 / good_docs, 0.5 / max(1.0, len(label) - label.sum())) / np.maximum(length, 1)  # both labels weigh the same
    kinds = np.stack([1 - label, label], axis=1)
    for step in range(1, steps + 1):
        if not len(x):
            break
        g = np.zeros(N_FEATURES + 7)
        for at in range(0, len(length), BATCH):  # so that what a step needs besides x is small
            docs = slice(at, at + BATCH)
            bounds = first[at : at + BATCH + 1]
            own, n = x[bounds[0] : bounds[-1]], length[docs]
            rows, _ = padded(own @ weight[:-1] + weight[-1], bounds - bounds[0])
            good, pairs, _ = forward_backward(rows, n, moves, start)
            marginal = good[np.repeat(np.arange(len(n)), n), np.arange(len(own)) - np.repeat(bounds[:-1] - bounds[0], n)]
            wrong = np.repeat(share[docs], n) * (np.repeat(label[docs], n) - marginal)
            seen = np.diag([((n - 1) * (1 - label[docs]) * share[docs]).sum(), ((n - 1) * label[docs] * share[docs]).sum()])
            g_moves = seen - (pairs * share[docs][:, None, None]).sum(axis=0)
            g_start = ((kinds[docs] - np.stack([1 - good[:, 0], good[:, 0]], axis=1)) * share[docs][:, None]).sum(axis=0)
            g += np.concatenate([wrong @ own, [wrong.sum()], g_moves.ravel(), g_start])
        g[:N_FEATURES] -= decay * weight[:-1]
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weight, moves, start = weight + move[: N_FEATURES + 1], moves + move[N_FEATURES + 1 : N_FEATURES + 5].reshape(2, 2), start + move[-2:]
    return Field(weight, moves, start, mean, scale, prior)


def document_scores(features: np.ndarray, length: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """The length-weighted mean of the marginals of each document's lines."""
    out = np.full(len(first) - 1, field.prior)
    lines = np.diff(first)
    unary = field.unary(features)
    some = np.flatnonzero(lines)
    some = some[np.argsort(lines[some], kind="stable")]
    at = 0
    while at < len(some):  # of like lengths together, so that little is padding
        most = int(lines[some[at]]) * 2 + 8
        until = at
        while until < len(some) and until - at < 512 and lines[some[until]] <= most:
            until += 1
        docs = some[at:until]
        where = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        bounds = np.concatenate([[0], np.cumsum(lines[docs])])
        rows, n = padded(unary[where], bounds)
        weights, _ = padded(length[where].astype(float), bounds)
        good, _, _ = forward_backward(rows, n, field.moves, field.start)
        out[docs] = (good * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1)
        at = until
    return np.clip(out, 0.0, 1.0)


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False)) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def _fitted(first: int, until: int) -> np.ndarray:
    """The lines of a document that it is fitted on: all, or MOST_RUNS runs."""
    if until - first <= MOST_LINES * MOST_RUNS:
        return np.arange(first, until)
    begins = np.linspace(first, until - MOST_LINES, MOST_RUNS).astype(np.int64)
    return (begins[:, None] + np.arange(MOST_LINES)).ravel()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            x, _, first = line_features(data, offsets)
            kept = [_fitted(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
            flat = x[np.concatenate(kept)].astype(np.float32)
            bounds = np.concatenate([[0], np.cumsum(list(map(len, kept)))]) * N_FEATURES
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(row, end - row), lists], names=["quality", "x"])


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS, steps: int = STEPS) -> Field:
    """A field fitted to at most ``most`` labelled documents outside the held-out fold. Of several texts of one doc_id one is taken, by its hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    share = known.agg(F.avg("quality")).first()[0]
    # both labels alike, by a hash of the id; what comes to one place is `most` ids
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for q in (0, 1)]
    picked = picked[0].unionByName(picked[1]).collect()
    if len({r.quality for r in picked}) < 2:
        return Field(np.zeros(N_FEATURES + 1), np.zeros((2, 2)), np.zeros(2), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5 if share is None else float(share))
    few = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in picked], "doc_id long, quality int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(few, "doc_id")
    # one row an id, before anything comes to one place
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "quality")
    got = one.mapInArrow(_sampled, "quality int, x array<float>").toArrow()
    runs, label = [], []
    for batch in got.to_batches():
        for q, flat in zip(batch.column("quality").to_pylist(), batch.column("x"), strict=True):
            lines = np.asarray(flat.values).reshape(-1, N_FEATURES)
            for at in range(0, len(lines), MOST_LINES):
                runs.append(lines[at : at + MOST_LINES])
                label.append(q)
    if not runs:
        return fit(np.empty((0, N_FEATURES)), np.array([0]), np.empty(0), 0, prior=share)
    # the order of rows from Spark is not fixed; that of a sum must be; and such of like length go together
    order = sorted(range(len(runs)), key=lambda i: (len(runs[i]), label[i], runs[i].tobytes()))
    first = np.concatenate([[0], np.cumsum([len(runs[i]) for i in order])])
    return fit(np.concatenate([runs[i] for i in order]).astype(float), first, np.array([label[i] for i in order]), steps, prior=share)


def _scorer(field: Field, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column(place)):
                x, length, first = line_features(data, offsets)
                score = pa.array(document_scores(x, length, first, field), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), score], names=[*batch.schema.names, "score"])

    return run


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """The columns of ``docs`` and score (one that is there already is replaced)."""
    given = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    # columns go by place, so that their names don't matter
    rows = given.toDF(*(f"c{i}" for i in range(len(given.columns))))
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(_scorer(field, given.columns.index("text")), schema).toDF(*given.columns, "score")
