"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of a few MB and builds a suffix array
over the words of each (prefix doubling, from three words on, as deep as the longest
test item). All suffixes of all test items are binary-searched in it at once, one
word deeper at a time: that yields each suffix's longest verbatim match with its
places, and, on the way, every place of each of the item's windows. Words compare by hashes
there; what matches is then compared letter by letter. No row is shuffled. The test
items go to the tasks in blocks of bounded size; if there is more than one block, the
documents are passed over once for each, one block after the other, and the driver holds one block at a time.

A window is WINDOW consecutive words of an item, or all of an item that has fewer
words. A document word inside any place of a window is hit. Null and empty texts
have no words, an item without words has no windows, an item without an item_id is
matched but not listed. Equal item_ids count once; of an item that repeats each text counts. Rows that repeat
stay. Other columns are ignored by `matches` and kept by `decontaminated`, whatever their names. Without
documents, or without items, nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runs import covered, merged
from tessera.llm.tables import free, written
from tessera.llm.textops import ALNUM, LOWER, Words, pieces

WINDOW = 10
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 16 << 20

#: Of a word's number, where three fit into a sort key; where numbers are larger, one does.
BITS = 21


@dataclass
class Tests:
    """A block of test items: the words of all (as hashes, and lower-cased), each item's first word and name."""

    words: np.ndarray
    letters: list[bytes]
    first: np.ndarray
    names: list[str | None]
    window: int

    @classmethod
    def of(cls, names: list, texts: list, window: int) -> Tests:
        words, letters, first = [], [], [0]
        for _, _, data, offsets in pieces(pa.array(texts, pa.string())):
            w = Words(data, offsets, ALNUM)
            words.append(w.hash)
            whole = LOWER[data].tobytes()
            letters += [whole[a:b] for a, b in zip(w.start, w.end, strict=True)]
            first += (w.first[1:] + first[-1] - w.first[0]).tolist() if len(offsets) > 1 else []
        return cls(np.concatenate(words) if words else np.empty(0, np.uint64), letters, np.array(first), [None if x is None else str(x) for x in names], window)


def suffix_array(ids: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``ids`` (1 and up) in order of their first ``depth`` words.

    A suffix ends with its text, at the place ``last`` has for it; ends come before words.
    """
    n = len(ids)
    at = np.arange(n)
    h = 3 if n == 0 or int(ids.max()) < 1 << BITS else 1
    key = ids << (2 * BITS) if h == 3 else ids.copy()
    for k in range(1, h):
        inside = at + k < last
        key[inside] |= ids[at[inside] + k] << ((2 - k) * BITS)
    order = np.argsort(key, kind="stable")
    new = np.empty(n, dtype=bool)
    new[:1] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, dtype=np.int64)  # of the group: the place of its first suffix in the order
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    rank[order] = np.repeat(begin, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that are not settled yet
    while h < depth and len(open_):
        who = order[open_]
        second = np.zeros(len(who), dtype=np.int64)
        inside = who + h < last[who]
        second[inside] = rank[who[inside] + h] + 1
        own = rank[who]
        sort = np.lexsort((second, own))
        who, own, second = who[sort], own[sort], second[sort]
        order[open_] = who
        new = np.empty(len(who), dtype=bool)
        new[:1] = True
        new[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(who)))
        rank[who] = np.repeat(open_[begin], size)
        # a group whose suffixes all ended is as ordered as it gets
        stays = np.repeat((size > 1) & (second[begin] > 0), size)
        open_ = open_[stays]
        h *= 2
    return order


def _narrowed(ids: np.ndarray, last: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of [lo, hi) whose word number ``depth`` is ``want``."""

    def bound(upper: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (a < b).any():
            m = (a + b) >> 1
            at = order[np.minimum(m, len(order) - 1)]
            place = at + depth
            word = np.where(place < last[at], ids[np.minimum(place, len(ids) - 1)], 0)
            right = (word <= want if upper else word < want) & (a < b)
            a = np.where(right, m + 1, a)
            b = np.where(right, b, np.maximum(np.where(a < b, m, b), a))
        return a

    return bound(False), bound(True)


def search(hashes: np.ndarray, first: np.ndarray, tests: Tests) -> tuple[np.ndarray, list[tuple[int, int, int, int]], list[tuple[int, int, np.ndarray]]]:
    """For the words of a shard: which are hit; (item, item word, shard word, length) of the longest matches; (item, word of all, shard words) of windows."""
    n = len(hashes)
    hit = np.zeros(n + 1, dtype=np.int64)
    n_test = len(tests.words)
    if not n or not n_test:
        return hit[:n] > 0, [], []
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    ids = ids.astype(np.int64) + 1
    last = np.repeat(first[1:], np.diff(first))
    item_len = np.diff(tests.first)
    order = suffix_array(ids, last, int(item_len.max()))
    place = np.searchsorted(vocabulary, tests.words)
    known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == tests.words
    test_ids = np.where(known, place + 1, -1)
    item = np.repeat(np.arange(len(item_len)), item_len)
    begin = np.arange(n_test)
    room = tests.first[item + 1] - begin  # words up to the item's end
    # a window of a short item is the item; of others, as long as there is room
    goal = np.minimum(tests.window, item_len[item])
    starts = np.where(item_len[item] < tests.window, begin == tests.first[item], room >= tests.window)
    active = begin[starts]
    first_ids = ids[order]
    lo = np.searchsorted(first_ids, test_ids[active], side="left")
    hi = np.searchsorted(first_ids, test_ids[active], side="right")
    longest, windows = [], []
    depth = 1
    while True:
        full = lo < hi
        done = full & (goal[active] == depth)
        for t, a, b in zip(active[done], lo[done], hi[done], strict=True):
            where = order[a:b]
            hit[where] += 1
            ends = where + goal[t]
            np.subtract.at(hit, ends, 1)
            windows.append((int(item[t]), int(t), where))
        # those that can't go deeper have their longest match here
        ended = full & (room[active] == depth)
        for t, a, b in zip(active[ended], lo[ended], hi[ended], strict=True):
            longest += [(int(item[t]), int(t - tests.first[item[t]]), int(p), depth) for p in order[a:b]] if depth >= goal[t] else []
        go = full & ~ended
        active, lo, hi = active[go], lo[go], hi[go]
        if not len(active):
            break
        a, b = _narrowed(ids, last, order, lo, hi, depth, test_ids[active + depth])
        stop = (a >= b) & (depth >= goal[active])
        for t, x, y in zip(active[stop], lo[stop], hi[stop], strict=True):
            longest += [(int(item[t]), int(t - tests.first[item[t]]), int(p), depth) for p in order[x:y]]
        lo, hi = a, b
        depth += 1
    return np.cumsum(hit)[:n] > 0, longest, windows


def verbatim(lower: bytes, w: Words, tests: Tests, windows: list[tuple[int, int, np.ndarray]]) -> bool:
    """Whether all windows are of equal words, not only of equal hashes."""
    size = np.minimum(tests.window, np.diff(tests.first)).tolist()
    start, end = w.start, w.end
    seen: set[tuple[int, int]] = set()
    for item, t, where in windows:
        for p in where.tolist():
            # of a window one word after another only the last is new
            for k in range(size[item] - 1 if (t - 1, p - 1) in seen else 0, size[item]):
                if lower[start[p + k] : end[p + k]] != tests.letters[t + k]:
                    return False
            seen.add((t, p))
    return True


def _digests(words: Iterator[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in words], dtype=np.uint64)


def named(lower: bytes, w: Words) -> np.ndarray:
    """The words of a shard by a cryptographic hash: slow, for shards in which the fast one met unlike words."""
    return _digests(lower[a:b] for a, b in zip(w.start, w.end, strict=True))


def named_tests(tests: Tests) -> np.ndarray:
    return _digests(iter(tests.letters))


MATCHES = "doc_id long, n_words long, hits array<struct<from:long,until:long>>, items array<string>, longest array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def _matcher(tests: Tests):
    out = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))),
        ("items", pa.list_(pa.string())), ("longest", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))), ("sha", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column("text"), SHARD_BYTES):
                w = Words(data, offsets, ALNUM)
                hit, longest, windows = search(w.hash, w.first, tests)
                if windows and not verbatim(LOWER[data].tobytes(), w, tests, windows):
                    hit, longest, windows = search(named(LOWER[data].tobytes(), w), w.first, replace(tests, words=named_tests(tests)))
                docs = end - row
                hits, items, best = [[] for _ in range(docs)], [set() for _ in range(docs)], [[] for _ in range(docs)]
                edges = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                # a run of hit words is cut where a document ends
                for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                    while a < b:
                        d = int(np.searchsorted(w.first, a, side="right")) - 1
                        until = min(b, int(w.first[d + 1]))
                        hits[d].append({"from": int(a - w.first[d]), "until": int(until - w.first[d])})
                        a = until
                for i, _, where in windows:
                    if tests.names[i] is not None:
                        for d in np.unique(np.searchsorted(w.first, where, side="right") - 1):
                            items[d].add(tests.names[i])
                for i, item_word, p, length in longest:
                    d = int(np.searchsorted(w.first, p, side="right")) - 1
                    best[d].append({"item_id": tests.names[i], "item_word": item_word, "doc_word": int(p - w.first[d]), "n_words": length})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, docs), pa.array(np.diff(w.first).astype(np.int64)), pa.array(hits, out.field("hits").type),
                     pa.array([sorted(x) for x in items], out.field("items").type), pa.array(best, out.field("longest").type), batch.column("sha").slice(row, docs)],
                    schema=out,
                )

    return run


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Tests]]:
    """How many blocks of about ``block_bytes`` the test items make, by the checked size of all; and the blocks, each fetched when it is asked for."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(total // block_bytes) + 1

    def each() -> Iterator[Tests]:
        for k in range(blocks):
            part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            got = part.collect()
            yield Tests.of([r.item_id for r in got], [r.text for r in got], window)

    return blocks, each()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and sha, by which texts are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("sha", F.sha2("text", 256))


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[DataFrame]:
    """MATCHES and sha of every row of ``docs``, for one block of items after the other.

    Of several blocks each result is written before the next block is fetched.
    """
    rows = _keyed(docs)
    blocks, tests = test_blocks(benchmark, window, block_bytes)
    for k, t in enumerate(tests):
        out = rows.mapInArrow(_matcher(t), MATCHES + ", sha string")
        # of later blocks only what they hit counts
        yield out if blocks == 1 else written(out if k == 0 else out.where("size(hits) > 0"), "matches")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words), items (with windows in the text, sorted), longest (matches that no
    longer one of the same item suffix beats in the shard) for every row of ``docs``."""
    first, *rest = _passes(docs, benchmark, window, block_bytes)
    if not rest:
        return first.drop("sha")
    # equal texts have equal matches
    more = reduce(DataFrame.unionByName, [x.dropDuplicates(["sha"]) for x in rest]).groupBy("sha")
    more = more.agg(F.flatten(F.collect_list("hits")).alias("h"), F.flatten(F.collect_list("items")).alias("i"), F.flatten(F.collect_list("longest")).alias("l"))
    both = lambda x, y: F.concat(x, F.coalesce(y, F.array()))
    out = first.join(more, "sha", "left")
    return out.select("doc_id", "n_words", merged(both("hits", "h")).alias("hits"), F.array_sort(F.array_distinct(both("items", "i"))).alias("items"), both("longest", "l").alias("longest"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match for every row of ``docs``."""
    found = matches(docs, benchmark, window).withColumn("n_hit", covered("hits"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("longest", lambda x: x["n_words"])), F.lit(0).cast("long")).alias("longest_match"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of any item.

    The text decides, not the id: rows that repeat a doc_id are told apart by their text.
    """
    found = [p.where("size(hits) > 0").select("sha") for p in _passes(docs.where("text is not null"), benchmark, window, block_bytes)]
    (sha,) = free(docs, "sha")
    gone = reduce(DataFrame.unionByName, found).distinct().withColumnRenamed("sha", sha)
    return docs.join(gone, F.sha2(F.col("text").cast("string"), 256) == F.col(sha), "left_anti")


def digest(items: list[str]) -> str:
    """What items_sha256 holds for these item_ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
