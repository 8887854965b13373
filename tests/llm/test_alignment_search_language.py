"""Aligned tokens, ranked search and language identification against brute force on small texts."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from math import floor, log, log2
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, language, queries, ranked_search

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(3)
SCHEMA = "doc_id long, text string, lang string, n long, score double, block long, term string"
ODD = [
    None, "", " ", "  ", "a ", "\n a\n  b", "x▁y z", "▁", "<s> a </s> <|endoftext|> <unk>", "a\x00b \x00", "　 a　 b", "\x1c c\x85 d", "ﬁ ½ é é İ", "<0x0A> b", "\t", "🎉 🎉🎉 ﻿a",
    "don't  stop\r\n\r\n  now", "a" * 700, "日本語 テキスト", "The the THE tHe", "the the the", "the the the",
]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, 0.5, 7, "t") for i, t in enumerate(texts)], SCHEMA)


# alignment


def brute_alignment(texts):
    """Links by comparing byte ranges; groups by common ends."""
    tokens = alignment.Tokens(BYTE_BPE, PIECE_BPE)
    rows, counts = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        sides = []
        for ids, size in ((tokens.a.encode(" " + (t or ""), add_special_tokens=False).ids, tokens.a_bytes), (tokens.b.encode(t or ""), tokens.b_bytes)):
            ends = np.cumsum([len(size[i]) for i in ids]).tolist()
            sides.append([(i, e - len(size[i]), e) for i, e in zip(ids, ends, strict=True)] if b"".join(size[i] for i in ids) == raw else None)
        if not t or None in sides:
            rows.append((0, 0, [], [], ""))
            continue
        a, b = sides
        links = [(x, y) for x, s, e in a for y, f, g in b if s < g and f < e]
        groups, i, j = [], 0, 0
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            left = [str(x) for x, _, e in a[i:] if e <= end]
            right = [str(x) for x, _, e in b[j:] if e <= end]
            i, j = i + len(left), j + len(right)
            groups.append(",".join(left) + "|" + ",".join(right))
        counts.update(links)
        rows.append((len(a), len(b), groups, links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(a, b, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), said) for a, b, g, links, said in rows]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_alignment(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    pool = ["the", " the", "  ", "\n", "é", "naïve", "x1", "ab▁", "don't", "🎉", ".", " Zürich", "unbelievable", " ", "123", "\t\t", "　"]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    got = alignment.aligned(table(spark, texts).repartition(3), BYTE_BPE, PIECE_BPE).orderBy("doc_id").collect()
    want = brute_alignment(texts)
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got] == want
    assert [r.groups_sha256 for r in got] == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]


def test_alignment_of_nothing_and_of_a_long_text(spark):
    docs = table(spark, ["the naïve one " * 30_000])
    assert alignment.aligned(docs.limit(0), BYTE_BPE, PIECE_BPE).count() == 0
    r = alignment.aligned(docs.withColumn("doc_id", F.lit(None).cast("long")), BYTE_BPE, PIECE_BPE).first()
    one = brute_alignment(["the naïve one " * 30])[0]
    tokens = alignment.Tokens(BYTE_BPE, PIECE_BPE)
    assert r.doc_id is None and r.n_a == len(tokens.a.encode(" " + "the naïve one " * 30_000, add_special_tokens=False).ids)
    assert (r.n_groups - 1) * 30 == (one[2] - 1) * 30_000
    none = alignment.aligned(table(spark, [None, ""]), BYTE_BPE, PIECE_BPE).collect()
    assert [(x.n_a, x.count_sum, x.groups, x.groups_sha256) for x in none] == [(0, 0, "", "")] * 2


def test_pointer_jumping():
    for _ in range(300):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, 30)))})) for _ in range(2))
        common = sorted(set(a.tolist()) & set(b.tolist()))
        want = [next(c for c in common if c >= e) for e in [*a.tolist(), *b.tolist()]]
        assert b[alignment.labels(a, b)].tolist() == want


def test_memory_of_a_block_of_new_words():
    """What Python and NumPy hold while a block is aligned: 164 MB when a block was aligned at once, 56 in parts."""
    tokens, letters = alignment.Tokens(BYTE_BPE, PIECE_BPE), "abcdefghijklmnoprstuvwyz"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(4, 11))) for _ in range(500)) for _ in range(240)]
    alignment._aligned_block(tokens, pa.array(["a few words first"]), False)
    tracemalloc.start()
    got = alignment._aligned_block(tokens, pa.array(texts), False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got["n_a"]) == 240 and 0 < got["n_a"].sum()
    assert peak < 90e6


def test_words_encoded_together_as_one_by_one(monkeypatch):
    pool = ["the", "é", "naïve", "ab▁", "▁", "don't", "🎉", "", "", "x\ty", "q" * 70, "a\n", "\n\nb", "<s>", "123.", "　"]
    texts = [*[t for t in ODD if t], *(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(200))]
    monkeypatch.setattr(alignment, "TOGETHER", 1)
    one = alignment.Tokens(BYTE_BPE, PIECE_BPE).encoded(texts)
    monkeypatch.setattr(alignment, "MOST_WORDS", 30)
    for together in (2, 7, 1024):
        monkeypatch.setattr(alignment, "TOGETHER", together)
        tokens = alignment.Tokens(BYTE_BPE, PIECE_BPE)
        for step in (len(texts), 9):
            parts = [tokens.encoded(texts[i : i + step]) for i in range(0, len(texts), step)]
            for kind in (0, 1):
                for side in (0, 1):
                    assert np.array_equal(np.concatenate([x[kind][side] for x in parts]), one[kind][side])


def test_other_pieces_are_refused():
    with pytest.raises(ValueError):
        alignment.Tokens(public_tokenizers.path("word_bpe_49k.json"), PIECE_BPE)


# ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(texts, items, k):
    docs = [(i, Counter(terms(t))) for i, t in texts if terms(t)]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(x for _, c in docs for x in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 20 * m)) for x in words if c[x])
            if s > 0:
                scored.append((-s, -1 if i is None else i))
        out += [(item, rank, None if i == -1 else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("bucket", "lead", "block"), [(1024, 2048, 4 << 20), (7, 5, 4 << 20), (16, 20, 300)])
def test_ranked_search(spark, monkeypatch, bucket, lead, block):
    monkeypatch.setattr(ranked_search, "BUCKET", bucket)
    monkeypatch.setattr(ranked_search, "LEAD", lead)
    word = lambda: rng.choice(["é", "a", "B", "b_c", "x9", "日本", *(f"w{int(rng.expovariate(0.05))}" for _ in range(8))])
    texts = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 20, 200])))) for i in range(300)]
    texts += [(1000 + i, texts[5][1]) for i in range(90)] + [(7, texts[7][1]), (None, texts[9][1]), (400, None), (401, ""), (402, "... --"), (403, "A" * 100_000 + " w1")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(12)] + [(3, "w1 w2"), (None, "w1 w1"), (90, None), (91, ""), (92, "never")]
    docs = spark.createDataFrame([(i, t, "en", 1, 0.5, 7, "t") for i, t in texts], SCHEMA).repartition(4)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = ranked_search.search(docs, asked, 10, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(texts, items, 10)
    assert ranked_search.search(docs.limit(0), asked, 10, block).count() == 0 == ranked_search.search(docs, asked.limit(0), 10, block).count()


def test_buckets_are_passed_over():
    """Cauchy-Schwarz and coordinates leave less than half of the documents that hold a term, and all of the best."""
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 400, size=20)) for _ in range(2000)]
    impacts = [r.integers(1, 1000, size=len(x)) ** 2 for x in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t))) for x, t in ((rows, np.int32), (impacts, np.int64))]
    length = np.array([np.sqrt((x.astype(float) ** 2).sum()) for x in impacts])
    bucket = ranked_search.Bucket(pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(length), *lists], names=["doc_id", "length", "terms", "impacts"]))
    places = np.arange(0, 400, 13)
    whole = bucket.exact(places, np.arange(2000))
    goal = float(np.sort(whole)[-10])
    left = bucket.survivors(places, goal)
    assert set(np.flatnonzero(whole >= goal)) <= set(left.tolist()) and len(left) < (whole > 0).sum() / 2
    assert whole.tolist() == [int(x[np.isin(t, places)].sum()) for t, x in zip(rows, impacts, strict=True)]


def test_unlike_terms_of_one_hash():
    asked = ranked_search.Asked.of(pa.array([1]), [["ab cd ef"]])
    asked.hashes[:] = asked.hashes[0]
    data = np.frombuffer(b"cd xx ef ab abc", np.uint8)
    w = ranked_search.Words(data, np.array([0, len(data)]), ranked_search.ALNUM)
    w.hash = np.full(len(w.hash), asked.hashes[0])
    word, term = asked.numbers(w, data)
    letters = [asked.letters[asked.at[k] : asked.at[k + 1]].tobytes() for k in range(3)]
    assert sorted((i, letters[k]) for i, k in zip(word.tolist(), term.tolist(), strict=True)) == [(0, b"cd"), (2, b"ef"), (3, b"ab")]


# languages


def brute_phrases(line, excerpts):
    """Longest substrings of any excerpt, from left to right; an unknown symbol is a phrase."""
    n = at = 0
    while at < len(line):
        end = at
        while end < len(line) and any(line[at : end + 1] in e for e in excerpts):
            end += 1
        at, n = max(end, at + 1), n + 1
    return n


def plain(text):
    return re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower()))


@pytest.mark.parametrize("few", [1, 24, 10**6])
def test_phrases_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(language, "FEW", few)
    monkeypatch.setattr(language, "PIECE_BYTES", 300)
    letters = {"aa": "abcé", "bb": "bcdß", "cc": "cdef"}
    make = lambda kind, n: "".join(rng.choice(letters[kind] + " .") for _ in range(n))
    samples = {kind: [make(kind, 60) for _ in range(6)] + ["same same"] * 2 for kind in letters}
    model = language.fitted(samples)
    texts = [make(rng.choice(list(letters)), rng.choice([1, 5, 40, 300])) for _ in range(60)] + ["abcé" * 200, "日本 x", "q", samples["bb"][0], "SAME  same", "A\n1 b", "...", "", None, "42"]
    got = language.predicted(table(spark, texts).coalesce(2), model).orderBy("doc_id").collect()
    sizes = [sum(len(plain(e)) + 1 for e in set(samples[x])) for x in model.languages]
    assert model.languages == sorted(letters) and model.sizes == sizes
    for r, t in zip(got, texts, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        line = plain(t)
        counts = [brute_phrases(line, [plain(e) for e in samples[x]]) for x in model.languages]
        entropy = [c * log2(n) / len(line) for c, n in zip(counts, sizes, strict=True)]
        assert (list(r.phrases), r.n_symbols) == (counts, len(line))
        one, two = sorted(entropy)[:2]
        assert r.lang_pred == model.languages[int(np.argmin(entropy))] and abs(r.score - (1 - one / two)) < 1e-9 and 0 <= r.score <= 1


def test_learning_of_nothing_and_of_one_language(spark):
    docs = table(spark, ["some words", None, "", "other words", "ещё", "x" * 300_000])
    assert {(r.lang_pred, r.score) for r in language.predicted(docs, language.trained(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {("und", 0.0)}
    one = language.trained(docs)
    assert one.languages == ["en"]
    assert [(r.lang_pred, r.score) for r in language.predicted(docs, one).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0), ("und", 0.0), ("en", 1.0), ("en", 1.0), ("en", 1.0)]
    assert language.trained(docs.limit(0)).languages == [] and language.predicted(docs.limit(0), one).count() == 0


def test_rows_held_out_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if crc32(str(i).encode()) % 3 != 1 else "зима лето", "en") for i in range(60)], "doc_id long, text string, lang string")
    model = language.trained(docs)
    assert all(model.symbol[ord(c)] == language.OTHER for c in "зима") and model.symbol[ord("a")] > language.BREAK
    assert {r.doc_id for r in docs.where(language.held_out()).collect()} == {i for i in range(60) if crc32(str(i).encode()) % 3 == 1}


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op13_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    apart = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(apart) > 250 and sum(r.lang == r.lang_pred for r in apart) >= 0.97 * len(apart)
