"""Language identification by cross-parsing: how few phrases of a language's labelled text does it take to write a text?

A language is learned from a bounded sample: EXCERPT characters, at a place that the id decides, of each of at most ROWS labelled
documents (those with the smallest hash of their id; equal excerpts count once), for the MOST_LANGUAGES languages with most documents. Their suffix automaton
knows every substring. A text is parsed from left to right into the longest phrases that the automaton knows, a letter that it
doesn't know being a phrase of its own. Phrases times the logarithm of the length of the labelled text, for each letter, estimate
the cross entropy; the language with the least wins, the first in order among equals.

Texts are lower-cased; runs of what is no letter are one space. Many texts are parsed at once, one letter of each in a step, with
NumPy: a text that can't go on begins its next phrase with the same letter, so all go on in step. When fewer than FEW are left,
these are parsed to their ends one by one, by the same tables.

``lang_pred`` is ``und`` and ``score`` 0 for a text that is null or has no letter, and for all texts if nothing could be learned. Else ``score`` is
by which share the best language's entropy is below the next one's: 0 for equals, 1 where there is no other language. Labelled rows whose
text or lang is null teach nothing; an empty lang is a language like others. Rows that repeat are predicted as often; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textops import pieces

#: The sample: ROWS * EXCERPT characters and breaks stay below 2^15, so that states fit into 16 bits.
ROWS = 128
EXCERPT = 192
MOST_LANGUAGES = 64
#: Letters that are told apart, those with most occurrences in the sample; others are as if they were not in it.
LETTERS = 250
PIECE_BYTES = 8 << 20
FEW = 24

SPACE, OTHER, BREAK = 0, 1, 2
PREDICTED = "doc_id long, lang_pred string, score double, n_symbols long, phrases array<long>"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The suffix automaton of ``symbols`` as a table of ``width`` transitions a state; state 0 is the start, and 0 means none."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.zeros((len(step), width), dtype=np.uint16)
    for state, ways in enumerate(step):
        for c, to in ways.items():
            # a phrase never goes over the end of an excerpt
            if c != BREAK:
                table[state, c] = to
    return table


@dataclass
class Model:
    """Languages in order; each one's automaton and length; the symbol of every code point."""

    languages: list[str]
    tables: list[np.ndarray]
    sizes: list[int]
    symbol: np.ndarray


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _lower(texts: list[str]) -> list[str]:
    return pc.utf8_lower(pa.array(texts, pa.large_string())).to_pylist()


def _joined(symbols: np.ndarray) -> np.ndarray:
    """Which symbols stay if runs of spaces become one."""
    keep = symbols != SPACE
    keep[1:] |= symbols[:-1] != SPACE
    keep[:1] = True
    return keep


def fitted(samples: dict[str, list[str]]) -> Model:
    """A model of excerpts by language."""
    languages = sorted(samples)
    texts = {x: _lower(sorted(set(samples[x]))) for x in languages}
    seen = Counter(c for ts in texts.values() for t in ts for c in t if c.isalpha())
    known = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
    symbol = np.fromiter((OTHER if chr(i).isalpha() else SPACE for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    for k, c in enumerate(known):
        symbol[ord(c)] = BREAK + 1 + k
    tables, sizes = [], []
    for x in languages:
        line: list[int] = []
        for t in texts[x]:
            own = symbol[_points(t)]
            line += own[_joined(own)].tolist() + [BREAK]
        tables.append(automaton(line, BREAK + 1 + len(known)))
        sizes.append(len(line))
    return Model(languages, tables, sizes, symbol)


def trained(docs: DataFrame) -> Model:
    """Learns from the documents (doc_id, text, lang) that are not held out."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").where(~held_out())
    most = [r.lang for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()]
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))).cast("int") + 1
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "excerpt")
    cut = rows.where(F.col("lang").isin(most)).select("doc_id", "lang", F.substring("text", place, F.lit(EXCERPT)).alias("excerpt"))
    samples: dict[str, list[str]] = {}
    # Spark keeps the first ROWS of each language within every task before it shuffles
    for r in cut.withColumn("at", F.row_number().over(order)).where(F.col("at") <= ROWS).select("lang", "excerpt").collect():
        samples.setdefault(r.lang, []).append(r.excerpt)
    return fitted(samples)


def phrases(table: np.ndarray, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many phrases each of some texts has: ``size`` symbols from ``start`` on; the longest texts come first."""
    width, flat = table.shape[1], table.ravel()
    count, state = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
    # how many texts have a symbol number t
    left = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    done = int(np.searchsorted(-left, -FEW, side="right"))
    for t in range(done):
        k = left[t]
        c = symbols[start[:k] + t]
        to = flat[state[:k] * width + c]
        stops = to == 0
        begin = flat[c]
        count[:k] += stops & (state[:k] != 0)
        count[:k] += stops & (begin == 0)
        state[:k] = np.where(stops, begin, to)
    ways = memoryview(flat)
    for i in range(int(left[done]) if done < len(left) else 0):
        at, n = int(state[i]), 0
        for c in symbols[start[i] + done : start[i] + size[i]].tolist():
            to = ways[at * width + c]
            if not to:
                n += at != 0
                to = ways[c]
                n += not to
            at = to
        state[i] = at
        count[i] += n
    return count + (state != 0)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """PREDICTED for every row of ``docs`` (doc_id, text): ``phrases`` by language, in the order of the model's languages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        bits = np.array([log2(max(n, 2)) for n in model.sizes])
        for batch in batches:
            lower = pc.utf8_lower(pc.fill_null(batch.column("text"), "").cast(pa.large_string()))
            for row, end, data, offsets in pieces(lower, PIECE_BYTES):
                own = model.symbol[_points(data.tobytes().decode())]
                # where each text begins among the code points
                begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
                # what follows a text's end is no part of a run
                keep = _joined(own)
                keep[begins[:-1][np.diff(begins) > 0]] = True
                at = np.concatenate([[0], np.cumsum(keep)])[begins]
                letter = np.concatenate([[0], np.cumsum(own != SPACE)])[begins]
                symbols, start, size = own[keep], at[:-1], np.diff(at)
                order = np.argsort(-size, kind="stable")
                counts = np.zeros((len(size), len(model.languages)), dtype=np.int64)
                for j, table in enumerate(model.tables):
                    counts[order, j] = phrases(table, symbols, start[order], size[order])
                some = (np.diff(letter) > 0) & (len(model.languages) > 0)
                name, score = np.full(len(size), -1), np.zeros(len(size))
                if len(model.languages):
                    entropy = counts * bits / np.maximum(size, 1)[:, None]
                    name = np.where(some, entropy.argmin(axis=1), -1)
                    two = np.sort(entropy, axis=1)[:, :2]
                    score = np.where(some, 1.0 if two.shape[1] < 2 else 1 - two[:, 0] / np.where(two[:, -1] > 0, two[:, -1], 1), 0.0)
                said = pa.array([*model.languages, "und"]).take(pa.array(np.where(name < 0, len(model.languages), name)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * len(model.languages)), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), said, pa.array(score), pa.array(size.astype(np.int64)), lists], names=["doc_id", "lang_pred", "score", "n_symbols", "phrases"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PREDICTED)
