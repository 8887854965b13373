"""BPE encoding and decoding, long text by tree concatenation.

A text of up to `longest` characters is a leaf and encoded at once. A longer one is cut into halves, again
and again, wherever the cuts fall, until the pieces are leaves. The leaves are encoded
in parallel (rows of their own, in whichever tasks), and the halves are joined level by
level. Around each join a window is encoded again, twice as large each time, until on
both sides of the join it holds a token that the side has at the same place; there
the sides and the window are put together. Merges and pre-splitting depend on adjacent
characters only: a side is right up to a token that an encoding with more text behind
it shares, and the window is right from there to the token that it shares with the other side. A
window that never agrees grows until it is both halves whole.

Within a leaf that is a whole text, words (white space ends them, and so does a run of letters) are encoded each
for itself, and every Python worker process keeps up to 2 x KEPT_WORDS of them, the ones it met last.

Null texts count as empty and have no tokens. Rows that repeat stay; equal long texts are encoded once.
Columns of the input pass through `encoded` under their own names, whatever these are; those named like its
results (n_tokens, ids_sha256, decoded_sha256, ids, decoded) are replaced. Ties cannot arise.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Characters of a leaf at most. On the tables here one document in 35 is longer, a quarter of all text.
LONGEST = 1 << 14
#: Characters on either side of a join that are encoded again at first.
WINDOW = 64
KEPT_WORDS = 120_000
#: Characters of the texts whose results go back to Spark together.
PIECE = 1 << 21

#: White space that the tokenizer drops; splitting there changes no token. In ASCII only.
SPACE = re.compile(r"[ \t\n\r]+")

#: Words that end where a run of letters does, or at white space.
LETTERS = re.compile(r"[^\W\d_]+|[^\s\w]+[^\W\d_]+|[^ \t\n\r]*?[^\W\d_]+|[^ \t\n\r]+")
#: How special tokens begin; they are matched before anything else, and as they are written.
SPECIAL = "<|"

# The normalisers and the pre-splitting that words and joins rely on, as tokenizer files state them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@cache
def tokenizer(path: str):
    """The tokenizer of a file, once a process; a file whose pre-splitting is another one is refused."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    stated = json.loads(t.to_str())
    splits = (stated["pre_tokenizer"] or {}).get("pretokenizers", [])
    same = (stated["normalizer"] or {}).get("normalizers") == NORMALIZERS and stated["model"].get("type") == "BPE" and stated["decoder"] is None
    same = same and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": PRE_SPLIT} and not splits[1]["use_regex"]
    if not same or any(not a["content"].startswith(SPECIAL) for a in stated["added_tokens"]):
        raise ValueError(f"{path}: a tokenizer that normalises, splits or decodes in a way this module doesn't know")
    t.no_truncation()
    t.no_padding()
    return t


@dataclass
class Tokens:
    """The tokens of text[begin:until]: their ids, and where each ends."""

    ids: np.ndarray
    ends: np.ndarray
    begin: int
    until: int

    def alone(self) -> np.ndarray:
        """Which tokens end where no other does (characters of several tokens share an end)."""
        out = np.ones(len(self.ends), dtype=bool)
        same = self.ends[1:] == self.ends[:-1]
        out[1:] &= ~same
        out[:-1] &= ~same
        return out


Encode = Callable[[str], tuple[Sequence[int], Sequence[int]]]


def plain(path: str) -> Encode:
    """(ids, ends) of a text that is encoded at once."""
    t = tokenizer(path)

    def encode(text: str) -> tuple[Sequence[int], Sequence[int]]:
        e = t.encode(text, add_special_tokens=False)
        return e.ids, [b for _, b in e.offsets]

    return encode


def composed(text: str) -> str:
    """The text in NFC, as the tokenizer would compose it; what is cut out of it stays so."""
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Where halves of halves of ``n`` characters, none longer than ``longest``, begin; and ``n``."""
    k = 1
    while -(-n // k) > longest:
        k *= 2
    return [i * n // k for i in range(k)] + [n]


def encoded_at(text: str, begin: int, until: int, encode: Encode) -> Tokens:
    ids, ends = encode(text[begin:until])
    return Tokens(np.array(ids, dtype=np.int32), np.array(ends, dtype=np.int64) + begin, begin, until)


def _shared(window: Tokens, side: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The places in both of tokens that the window and the side have alike, at the same place of the text."""
    at = np.searchsorted(side.ends, window.ends)
    at = np.minimum(at, len(side.ends) - 1)
    same = (side.ends[at] == window.ends) & (side.ids[at] == window.ids) & window.alone() & side.alone()[at]
    own = np.flatnonzero(same)
    return own, at[own]


def joined(text: str, left: Tokens, right: Tokens, encode: Encode, window: int = WINDOW) -> Tokens:
    """The tokens of two adjacent stretches of ``text``, given each one's own."""
    cut = right.begin
    if not len(left.ids) or not len(right.ids):
        return Tokens(np.concatenate([left.ids, right.ids]), np.concatenate([left.ends, right.ends]), left.begin, right.until)
    while True:
        # a window begins and ends where tokens of the sides do
        k = int(np.searchsorted(left.ends, cut - window, side="right"))
        m = int(np.searchsorted(right.ends, cut + window, side="left"))
        again = encoded_at(text, int(left.ends[k - 1]) if k else left.begin, int(right.ends[m]) if m < len(right.ends) else right.until, encode)
        first, last, head, tail = 0, len(again.ids) - 1, 0, len(right.ids)
        if k:  # the window's first token and the side's last may stand otherwise only because the text ends there
            own, at = _shared(again, left)
            fits = (own > 0) & (at < len(left.ids) - 1) & (again.ends[own] < cut)
            first, head = (int(own[fits][0]), int(at[fits][0])) if fits.any() else (-1, 0)
        if m < len(right.ids):
            own, at = _shared(again, right)
            fits = (own < len(again.ids) - 1) & (at > 0) & (again.ends[own] > cut)
            last, tail = (int(own[fits][-1]), int(at[fits][-1]) + 1) if fits.any() else (-2, 0)
        if first >= 0 and last >= -1:
            parts = [(left, 0, head), (again, first, last + 1), (right, tail, len(right.ids))]
            return Tokens(np.concatenate([x.ids[a:b] for x, a, b in parts]), np.concatenate([x.ends[a:b] for x, a, b in parts]), left.begin, right.until)
        window *= 2


def concatenated(text: str, parts: list[Tokens], encode: Encode) -> Tokens:
    """The parts, in order, joined two by two, level by level."""
    while len(parts) > 1:
        parts = [joined(text, *parts[i : i + 2], encode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def split(text: str) -> list[str]:
    """Words that the tokenizer encodes each for itself.

    Of letters only U+0130 gets a mark when lower-cased, which then joins what follows.
    """
    if SPECIAL in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
        return [w for w in SPACE.split(text) if w]
    return LETTERS.findall(text.encode().lower().decode())  # A-Z only, as the tokenizer would


#: Below this code point words of letters are lower-cased here as the tokenizer does it.
LATIN = "\u0250"
_shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
#: The characters that stand for bytes: those that show stand for themselves, the others come from 256 on.
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _shown)}


class Words(dict):
    """Words' ids as text, made when they are first asked for; of the words kept the older half goes when there are too many."""

    def __init__(self, path: str):
        self.encode, self.merged = plain(path), tokenizer(path).model.tokenize
        self.before: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        ids = self.before.get(word)
        if ids is None:
            if word.isalpha() and max(word) < LATIN and "\u0130" not in word:
                # letters only: one word of the pre-splitting, which the merges alone encode
                found = [t.id for t in self.merged(word.lower().encode().decode("latin-1").translate(BYTES))]
            else:
                found = self.encode(word)[0]
            ids = " ".join(map(str, found))
        if len(self) >= KEPT_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Encodes texts word by word. One a process: see `encoder`."""

    def __init__(self, path: str):
        self.known = Words(path)
        self.token = {str(i): t for t, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}

    def ids(self, text: str) -> str:
        """The ids of a text with spaces between them."""
        found = [self.known[w] for w in split(text)]
        return " ".join(found if all(found) else filter(None, found))

    def decoded(self, ids: str) -> str:
        """What the ids decode to: a tokenizer without a decoder puts spaces between its tokens."""
        return " ".join([self.token[i] for i in ids.split(" ")]) if ids else ""


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


DIGESTS = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
WHOLE = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]


def _results(encoder: Encoder, ids: list[str], with_ids: bool) -> list[pa.Array]:
    """The columns of DIGESTS, and with_ids of WHOLE, for texts of which the ids are given."""
    decoded = [encoder.decoded(x) for x in ids]
    sha = lambda texts: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())
    n = [x.count(" ") + 1 if x else 0 for x in ids]
    out = [pa.array(n, pa.int64()), sha(ids), sha(decoded)]
    if with_ids:
        flat = np.array(" ".join(filter(None, ids)).split(), dtype=np.int32)
        out += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())]
    return out


def _pieces(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about PIECE characters together."""
    begin = total = 0
    for k, n in enumerate(lengths):
        total += n
        if total >= PIECE or k == len(lengths) - 1:
            yield begin, k + 1
            begin, total = k + 1, 0


def _short(path: str, place: int, kept: list[int], with_ids: bool, names: list[str]):
    """Encodes the texts in the column at ``place`` as a whole, and hands on the ``kept`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in _pieces(list(map(len, texts))):
                out = [batch.column(i).slice(a, b - a) for i in kept]
                yield pa.RecordBatch.from_arrays(out + _results(own, [own.ids(t) for t in texts[a:b]], with_ids), names=names)

    return run


LEAF = "key string, leaf int, piece string"
ENCODED_LEAF = f"{LEAF}, ids array<int>, steps array<int>"


def _leaves(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = composed(text)
                at = cuts(len(text), longest)
                pieces = [text[a:b] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], names=["key", "leaf", "piece"])

    return run


def _leaf_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = plain(path)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ends = encode(batch.column("piece")[row].as_py())
                one = lambda x: pa.array([x], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, 1) for c in ("key", "leaf", "piece")] + [one(np.array(ids, np.int32)), one(np.diff(np.array(ends, np.int32), prepend=0))], names=["key", "leaf", "piece", "ids", "steps"])

    return run


def _joined(path: str, with_ids: bool, names: list[str]):
    """Texts from their encoded leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encode = encoder(path), plain(path)
        for batch in batches:
            for row in range(batch.num_rows):
                leaves = batch.column("leaves")[row].values
                order = np.argsort(leaves.field("leaf").to_numpy())
                pieces = [leaves.field("piece")[int(k)].as_py() for k in order]
                text, at, parts = "".join(pieces), 0, []
                for k, piece in zip(order, pieces, strict=True):
                    ids, steps = (leaves.field(c)[int(k)].values.to_numpy() for c in ("ids", "steps"))
                    parts.append(Tokens(ids, np.cumsum(steps, dtype=np.int64) + at, at, at + len(piece)))
                    at += len(piece)
                ids = concatenated(text, parts, encode).ids
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(row, 1), *_results(own, [" ".join(map(str, ids.tolist()))], with_ids)], names=names)

    return run


def encoded(docs: DataFrame, path: str, with_ids: bool = True, longest: int = LONGEST) -> DataFrame:
    """Per row of ``docs``: its columns, n_tokens, ids_sha256, decoded_sha256, and with_ids ids and decoded too.

    Without with_ids the text is left out. ``longest`` is the most characters of a leaf.
    """
    made = StructType(DIGESTS + (WHOLE if with_ids else []))
    tokenizer(path)  # a file that can't be used fails here
    given = docs.drop(*DIGESTS_AND_WHOLE).withColumn("text", F.col("text").cast("string"))
    # columns go by place, so that their names don't matter
    place = given.columns.index("text")
    rows = given.toDF(*(f"c{i}" for i in range(len(given.columns))))
    text = F.col(f"c{place}")
    kept = [i for i in range(len(rows.columns)) if with_ids or i != place]
    schema = StructType([rows.schema[i] for i in kept] + made.fields)
    is_long = F.coalesce(F.length(text) > longest, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_short(path, place, kept, with_ids, schema.names), schema)
    # keyed by what they say: equal texts share their leaves, and a leaf that is made again is the same
    long = rows.where(is_long)
    leaves = long.select(F.sha2(text, 256).alias("key"), text.alias("text")).mapInArrow(_leaves(longest), LEAF)
    leaves = leaves.groupBy("key", "leaf").agg(F.first("piece").alias("piece")).mapInArrow(_leaf_tokens(path), ENCODED_LEAF)
    wholes = leaves.groupBy("key").agg(F.collect_list(F.struct("leaf", "piece", "ids", "steps")).alias("leaves"))
    keyed = StructType([StructField("key", StringType()), *made.fields])
    wholes = wholes.mapInArrow(_joined(path, with_ids, keyed.names), keyed)
    long = long.withColumn("key", F.sha2(text, 256)).select(*(f"c{i}" for i in kept), "key")
    return short.unionByName(long.join(wholes, "key").drop("key")).toDF(*(given.columns[i] for i in kept), *made.names)


DIGESTS_AND_WHOLE = [f.name for f in DIGESTS + WHOLE]
