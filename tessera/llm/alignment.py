"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

A text is encoded with a space before it by a byte-level BPE (A), and as it is by a BPE of pieces, which adds that
space (B). Both sequences of tokens tile the same bytes. Every token points to the token of the other side that overlaps it
and ends farthest to the right; a B token that ends where that token ends points to itself. Doubling all pointers at
once (each takes its target's target) until none changes leads every token to the last B token of its group: the label.
A block is a run of documents of about BLOCK_BYTES, or one longer document; its documents are doubled with NumPy, many together.

An A and a B token are linked where their byte ranges overlap. How often a pair of ids is linked in all documents is
counted in Spark: each block is a row with its different pairs and their numbers; the pairs of all blocks are summed; the
sums go back to the blocks that asked, dealt by pair and salt, so that a pair that every block has meets in no one task.
Nothing is broadcast or collected, and a task holds one block.

Texts are cut before a space that follows something else than white space: no token of either kind crosses such a place, so
words are encoded once per worker and kept, up to MOST_WORDS; those that are new are encoded as one text, some at a time, and told
apart by their bytes. Tokenizers of which this doesn't hold are refused. A block is aligned in parts of PART_BYTES, so that what a
worker holds besides its batch and its words is small.

Texts that are null, empty, or whose joined bytes differ from space+text (the piece model says U+2581 and a space alike) have no
tokens: all numbers are 0 and groups is ''. Rows that repeat count as often; a doc_id that repeats is a row each time. Other columns
are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.tables import written
from tessera.llm.textops import pieces

BLOCK_BYTES = 1 << 20
#: Of a block's documents that are encoded and aligned at a time, or one longer document.
PART_BYTES = 1 << 18
#: Words that a worker keeps the tokens of, of up to WORD_CHARS characters; where there are more it begins anew.
MOST_WORDS = 1 << 17
WORD_CHARS = 64
#: New words that are encoded as one text.
TOGETHER = 1 << 10
#: Parts that the blocks which ask for one pair are dealt into.
SALTS = 16

#: A space and all up to the next one that follows something else than white space.
WORD = re.compile(r" (?:[^ ]+|(?<=\s) )*")

BLOCK = (
    "block long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups array<string>, groups_sha256 array<string>, "
    "pairs array<long>, times array<int>, links binary"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


@cache
def _byte_of() -> dict[str, int]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """Both tokenizers, the bytes of each of their entries, and the words that were encoded before."""

    def __init__(self, byte_file: str, piece_file: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(byte_file, encoding="utf-8") as f:
            said = json.load(f)
        how = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex", True):
            raise ValueError(f"{byte_file} is no byte-level tokenizer that splits words as expected")
        self.a, self.b = Tokenizer.from_file(byte_file), SentencePieceProcessor(model_file=piece_file)
        self.a.encode_special_tokens = True
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"{piece_file} has pieces that go on after a space")
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        letters, entries = _byte_of(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self._forget()
        # a token with what follows it, A's first: more of its own side, the other side or the next group, nothing
        self.said = [b"%d%s" % (i, mark) for i in range(len(self.a_bytes)) for mark in (b",", b"|")] + [b"%d%s" % (i, mark) for i in range(len(self.b_bytes)) for mark in (b",", b";", b"")]

    def _forget(self) -> None:
        """``slot``: the number of each kept word; ``ids`` and ``at``: for each side the ids of all of them, and where each word's begin (one more at the end); ``same``: whether its bytes are its tokens' on both sides."""
        self.slot: dict[str, int] = {}
        self.ids, self.at = ([np.zeros(n, kind) for _ in range(2)] for n, kind in ((0, np.int32), (1, np.int64)))
        self.same = np.zeros(0, bool)

    def _bytes(self, side: int, ids: np.ndarray) -> bytes:
        entries = (self.a_bytes, self.b_bytes)[side]
        return b"".join([entries[i] for i in ids.tolist()])

    def _one(self, word: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        ids = [self.a.encode(word, add_special_tokens=False).ids, self.b.encode(word[1:]) if len(word) > 1 else [self.space]]  # a lone space is a piece of its own only after other text
        ids = [np.array(x, np.int32) for x in ids]
        same = all(self._bytes(k, x) == word.encode() for k, x in enumerate(ids))
        return ids, [np.array([len(x)]) for x in ids], np.array([same])

    def _encoded(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each side the ids of all words and how many each has; whether a word's bytes are its tokens' on both sides."""
        if len(words) > 1 and not any(w[-1].isspace() for w in words[:-1]):
            text = "".join(words)
            raw, end = text.encode(), np.cumsum([len(w.encode()) for w in words])
            ids = [np.array(x, np.int32) for x in (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]))]
            if all(self._bytes(k, x) == raw for k, x in enumerate(ids)):
                ends = [np.cumsum(size[x]) for size, x in zip((self.a_size, self.b_size), ids, strict=True)]
                upto = [np.searchsorted(e, end) for e in ends]
                if all(np.array_equal(e[u], end) for e, u in zip(ends, upto, strict=True)):
                    return ids, [np.diff(u + 1, prepend=0) for u in upto], np.ones(len(words), bool)
        if len(words) == 1:
            return self._one(words[0])
        # a word that is said otherwise is among them: halves
        return self._joined([self._encoded(words[: len(words) // 2]), self._encoded(words[len(words) // 2 :])])

    @staticmethod
    def _joined(parts: list) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        ids, number = ([np.concatenate([p[i][k] for p in parts]) for k in (0, 1)] for i in (0, 1))
        return ids, number, np.concatenate([p[2] for p in parts])

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each side the ids (int32) of all texts, one text after the other, and how many each has; none where it has no tokens."""
        split = [WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.slot) > MOST_WORDS:
            self._forget()
        slot, had = self.slot, len(self.slot)
        new = sorted({w: None for words in split for w in words if w not in slot}, key=lambda w: len(w) > WORD_CHARS)
        at, flat, same = self.at, self.ids, self.same
        if new:
            ids, number, fits = self._joined([self._encoded(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)])
            flat = [np.concatenate(x) for x in zip(flat, ids, strict=True)]
            at = [np.concatenate([a, a[-1] + np.cumsum(n)]) for a, n in zip(at, number, strict=True)]
            same = np.concatenate([same, fits])
            slot.update(zip(new, range(had, had + len(new)), strict=True))
        first = np.concatenate([[0], np.cumsum([len(words) for words in split], dtype=np.int64)])
        said = np.fromiter((slot[w] for words in split for w in words), np.int64, int(first[-1]))
        # long words are forgotten at once
        while new and len(new[-1]) > WORD_CHARS:
            del slot[new.pop()]
        keep = had + len(new)
        self.at, self.same = [a[: keep + 1].copy() for a in at], same[:keep].copy()
        self.ids = [x[: a[-1]].copy() for x, a in zip(flat, self.at, strict=True)]
        out, numbers = [], []
        for a, x in zip(at, flat, strict=True):
            n = a[said + 1] - a[said]
            upto = np.concatenate([[0], np.cumsum(n)])
            out.append(x[np.repeat(a[said] - upto[:-1], n) + np.arange(upto[-1])])
            numbers.append(np.diff(upto[first]))
        odd = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(~same[said])])[first]))
        if len(odd):
            begin = [np.concatenate([[0], np.cumsum(n)]) for n in numbers]
            none = [i for i in odd.tolist() if any(self._bytes(k, out[k][begin[k][i] : begin[k][i + 1]]) != (" " + texts[i]).encode() for k in (0, 1))]
            for k in (0, 1):
                kept = np.ones(len(texts), bool)
                kept[none] = False
                out[k], numbers[k] = out[k][np.repeat(kept, numbers[k])], numbers[k] * kept
        return out, numbers


@cache
def _tokens(byte_file: str, piece_file: str) -> Tokens:
    return Tokens(byte_file, piece_file)


def labels(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For the tokens of side A, then those of side B, which end at these places: the B token that ends their group."""
    n = len(a_end)
    # of all that overlap a token, that which has its last byte ends last
    to_b = np.searchsorted(b_end, a_end)
    to_a = np.searchsorted(a_end, b_end)
    itself = np.arange(n, n + len(b_end))
    at = np.concatenate([n + to_b, np.where(a_end[to_a] == b_end, itself, to_a)])
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at - n
        at = further


def linked(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, where it ends) of every overlap, from left to right: each ends where one of the two does."""
    both = np.concatenate([a_end, b_end])
    both.sort(kind="stable")
    ends = both[np.append(both[1:] != both[:-1], True)] if len(both) else both
    return np.searchsorted(a_end, ends), np.searchsorted(b_end, ends), ends


def _aligned_part(tokens: Tokens, texts: list[str], with_groups: bool) -> tuple[dict[str, list], np.ndarray]:
    """The columns of BLOCK from n_a to groups_sha256, and the id pair of each link."""
    (a, b), (n_a, n_b) = tokens.encoded(texts)
    a_end, b_end = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
    a_first, b_first = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    label = labels(a_end, b_end)
    last = np.zeros(len(b) + 1, dtype=np.int64)
    last[label[len(a) :] + 1] = 1
    before = np.cumsum(last)  # groups that end before a B token
    group_a, group_b = before[label[: len(a)]], before[label[len(a) :]]
    # where each token comes in the groups' line: after all tokens of earlier groups, A before B
    groups = int(before[-1])
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    upto_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
    a_ends = np.append(group_a[1:] != group_a[:-1], True) if len(a) else np.zeros(0, bool)
    b_ends = (np.append(group_b[1:] != group_b[:-1], True) if len(b) else np.zeros(0, bool)).astype(np.int64)
    b_ends[b_first[1:][n_b > 0] - 1] = 2
    line = np.empty(len(a) + len(b), dtype=np.int64)
    line[np.arange(len(a)) + before_b[group_a]] = 2 * a.astype(np.int64) + a_ends
    line[np.arange(len(b)) + upto_a[group_b]] = 2 * len(tokens.a_bytes) + 3 * b.astype(np.int64) + b_ends
    begin, said = (a_first + b_first).tolist(), tokens.said.__getitem__
    hashes, lines = [], []
    for i, j in zip(begin, begin[1:], strict=False):
        whole = b"".join(map(said, line[i:j].tolist()))
        hashes.append(hashlib.sha256(whole).hexdigest() if whole else "")
        lines.append(whole.decode() if with_groups else None)
    link_a, link_b, ends = linked(a_end, b_end)
    first_link = np.searchsorted(ends, np.concatenate([[0], a_end])[a_first], side="right")
    got = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(before[b_first]), "n_links": np.diff(first_link), "groups": lines, "groups_sha256": hashes}
    return got, a[link_a].astype(np.int64) * len(tokens.b_bytes) + b[link_b]


def _aligned_block(tokens: Tokens, texts: pa.Array, with_groups: bool) -> dict[str, list]:
    """The columns of BLOCK from n_a on; some of the texts are aligned at a time."""
    made = [_aligned_part(tokens, [t or "" for t in texts.slice(row, end - row).to_pylist()], with_groups) for row, end, _, _ in pieces(texts, PART_BYTES)]
    got = {c: np.concatenate([m[0][c] for m in made]) for c in ("n_a", "n_b", "n_groups", "n_links")}
    got |= {c: [x for m in made for x in m[0][c]] for c in ("groups", "groups_sha256")}
    pairs, at, times = np.unique(np.concatenate([m[1] for m in made]), return_inverse=True, return_counts=True)
    return got | {"pairs": pairs, "times": times, "links": at.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32).tobytes()}


def blocks(docs: DataFrame, byte_file: str, piece_file: str, with_groups: bool = True) -> DataFrame:
    """BLOCK: a row for each block of documents, written. A block's number is that of its partition, and of it there."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], BLOCK).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = _tokens(byte_file, piece_file), TaskContext.get().partitionId() << 32
        for batch in batches:
            text = batch.column("text")
            for row, end, _, _ in pieces(text, BLOCK_BYTES):
                got = _aligned_block(tokens, text.slice(row, end - row), with_groups)
                got |= {"block": block, "doc_id": batch.column("doc_id").slice(row, end - row).to_pylist()}
                yield pa.RecordBatch.from_arrays([pa.array([got[f.name]], f.type) for f in schema], schema=schema)
                block += 1

    return written(rows.mapInArrow(run, BLOCK), "aligned")


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, n: how often each pair of ids is linked in all blocks."""
    pairs = made.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    return pairs.groupBy("pair").agg(F.sum("times").alias("n"))


def aligned(docs: DataFrame, byte_file: str, piece_file: str, with_groups: bool = True) -> DataFrame:
    """ALIGNED for every row of ``docs`` (doc_id, text): groups is `a1,a2|b1;a3|b2,b3`, the ids of each group's A and B tokens."""
    made = blocks(docs, byte_file, piece_file, with_groups)
    width = _tokens(byte_file, piece_file).b.get_piece_size()
    counts = written(pair_counts(made), "pairs")
    most = Window.partitionBy(F.col("pair") % width)  # of one B id: at most as many pairs as there are A ids
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(most))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = made.select("block", F.explode("pairs").alias("pair")).withColumn("salt", (F.pmod(F.xxhash64("block"), F.lit(SALTS))).cast("int"))
    answers = asked.hint("shuffle_merge").join(counts, ["pair", "salt"]).select("block", F.struct("pair", "n", "best").alias("x")).groupBy("block").agg(F.collect_list("x").alias("known"))
    rows = made.drop("times").join(answers, "block", "left").select("*", F.col("known.pair").alias("pair"), F.col("known.n").alias("n"), F.col("known.best").alias("best")).drop("known", "block")

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ALIGNED).schema)

    def values(column: pa.Array, i: int) -> np.ndarray:
        got = column[i].values
        return np.empty(0, np.int64) if got is None else np.asarray(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = {c: batch.column(c) for c in batch.schema.names}
                order = np.argsort(values(part["pair"], i))
                n, best = values(part["n"], i)[order].astype(np.int64), values(part["best"], i)[order].astype(np.int64)
                at = np.frombuffer(part["links"][i].as_py(), np.uint16 if len(n) <= 1 << 16 else np.uint32)
                first = np.concatenate([[0], np.cumsum(values(part["n_links"], i), dtype=np.int64)])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[first])
                out = {"n_best": pa.array(total(best)), "count_sum": pa.array(total(n))}
                yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else part[f.name][i].values.cast(f.type) for f in schema], schema=schema)

    out = rows.mapInArrow(run, ALIGNED)
    return out if with_groups else out.drop("groups")
