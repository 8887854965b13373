"""Blocks of postings, the vocabulary by differences, merges, blank replacements, filters by bounds, and clusters with bounds."""

import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, dense, embeddings, index, sparse
from tessera.operators.embeddings import HashingEmbeddings
from tessera.operators.index import Changed, Manager
from tessera.plans import queries as registered
from tessera.plans.pipeline import Retrieval
from tessera.sources import loaders

rng = random.Random(8)


def text(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join(f"w{int(r.expovariate(0.02))}" for _ in range(n))


def documents(spark, rows):
    return loaders.from_table(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def whole(docs):
    """Whole documents as chunks."""
    return docs.where("trim(text) <> ''").select("doc_id", F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", F.lit(0).alias("chunk_index"))


def manager(spark, path, **how):
    return Manager(spark, str(path), **{"embeddings": HashingEmbeddings(16), "chunk": whole} | how)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def key(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in hits.collect())


def plain(spark, rows, queries, k):
    """The search of an index that is made for it."""
    chunks = spark.createDataFrame([(i, t) for i, t, _ in rows if t and t.strip()], "chunk_id long, content string")
    return key(sparse.search(sparse.build(chunks), queries, k))


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK", 8)
    rows = [(i, text(rng.choice([5, 40, 300])), f"s{i % 3}") for i in range(400)] + [(1000 + i, "w1 w2 w3", "s9") for i in range(40)]
    m = manager(spark, tmp_path / "i")
    m.index_documents(documents(spark, rows))
    queries = asked(spark, "w1 w2 w2 w300 w250", "w211", text(30), "never", "w1 w2 w3", "")
    assert key(sparse.search(m.index(), queries, 7)) == plain(spark, rows, queries, 7)
    # one rare term: its blocks alone can have hits
    found = sparse.Pruned(m.index(), sparse._asked(asked(spark, text(30), rows[7][1]), m.params), 3)
    bounds = found.bounds.groupBy("needed").count().collect()
    assert {r.needed for r in bounds} == {True, False}
    # what a block scores stays below its bound
    scores = found._scored(found.bounds.withColumn("lead", F.lit(True)))
    every = m.index().rows.select("seq", "block", F.inline("postings")).select("seq", "block", "chunk_id").distinct()
    most = scores.join(every, "chunk_id").groupBy("query_id", "seq", "block").agg(F.max("score").alias("most"))
    assert most.join(found.bounds, ["query_id", "seq", "block"]).where("most > bound + 1e-9").count() == 0
    only = sparse.search(m.index(), queries, 7, m.table("vectors"), {"source": "s9"})
    assert {r.chunk_id for r in only.collect()} <= {1000 + i for i in range(40)} and only.where("query_id = 4").count() == 7


def test_scores_by_batches_and_by_shuffles(spark, monkeypatch):
    rows = [(i, text(rng.choice([0, 5, 200])), "s") for i in range(150)] + [(1000 + i, "w1 w2 w3", "s") for i in range(30)]
    queries = asked(spark, "w1 w2 w2 w300 w250", "w211", text(30), "never", "w1 w2 w3", "", None)
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, source string").repartition(3)
    index, filters = sparse.build(chunks.withColumn("source", F.col("chunk_id").cast("string").substr(1, 1))), {"source": "1"}
    marked = chunks.withColumn("source", F.col("chunk_id").cast("string").substr(1, 1))
    whole, some = key(sparse.search(index, queries, 4)), key(sparse.search(index, queries, 4, marked, filters))
    assert len(whole) >= 12 and {q for q, *_ in whole} == {0, 1, 2, 4} and all(str(c)[0] == "1" for _, _, c, _ in some)
    with monkeypatch.context() as m:
        m.setattr(sparse, "MOST_SCORES", 20)
        m.setattr(sparse, "QUERIES", 2)
        assert key(sparse.search(index, queries, 4)) == whole and key(sparse.search(index, queries, 4, marked, filters)) == some
    monkeypatch.setattr(sparse, "MOST_ASKED", 0)
    assert key(sparse.search(index, queries, 4)) == whole and key(sparse.search(index, queries, 4, marked, filters)) == some
    assert sparse.search(index, asked(spark, "never", ""), 4).count() == 0 == sparse.search(index, queries.limit(0), 4).count()


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    m = manager(spark, tmp_path / "i")
    m.index_documents(documents(spark, [(i, text(60), "s") for i in range(100)]))
    queries = asked(spark, "w1 w1", "w2")
    want = key(sparse.search(m.index(), queries, 3))
    folders = {r.b for r in spark.createDataFrame([("w1",), ("w2",)], "term string").select(sparse.bucket().alias("b")).collect()}
    gone = [p for name in ("postings", "frequencies") for p in (tmp_path / "i" / name).glob("seq=*/run=*/bucket=*") if int(p.name[7:]) not in folders]
    assert len(gone) > 20
    for p in gone:
        shutil.rmtree(p)
    assert want and key(sparse.search(m.index(), queries, 3)) == want


def test_vocabulary_by_differences(spark, tmp_path):
    m, state = manager(spark, tmp_path / "i", fanout=3), {}
    for step in range(3):
        rows = [(rng.randrange(40), text(rng.choice([0, 3, 20])), "s") for _ in range(12)]
        rows = list({r[0]: r for r in rows}.values())
        m.index_documents(documents(spark, rows))
        state |= {r[0]: r for r in rows}
        gone = rng.sample(sorted(state), 2)
        m.delete_documents(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
        for g in gone:
            del state[g]
        if step % 2:
            m.merge()
        left = [r for r in state.values() if r[1].strip()]
        index = m.index()
        want = sparse.build(spark.createDataFrame([(i, t) for i, t, _ in left], "chunk_id long, content string"))
        assert (index.n, index.avgdl) == (want.n, want.avgdl)
        assert sorted(map(tuple, index.vocab.collect())) == sorted(map(tuple, want.vocab.collect()))
        assert not any("postings" in f for f in index.vocab.inputFiles())
    queries = asked(spark, "w1 w2 w20", text(10))
    assert key(sparse.search(m.index(), queries, 5)) == plain(spark, left, queries, 5)
    assert m.stats().first().bm25_vocabulary_size == want.vocab.count()


def test_blank_texts_take_documents_out(spark, tmp_path):
    m = manager(spark, tmp_path / "i")
    m.index_documents(documents(spark, [(1, "alpha beta", "a"), (2, "beta gamma", "b"), (3, "", "c")]))
    got = m.index_documents(documents(spark, [(1, "  ", "a"), (2, "beta gamma", "b"), (4, None, "d")]))
    assert got == {"indexed_documents": 0, "skipped_documents": 3, "new_chunks": 0, "total_chunks": 1, "total_documents": 1}
    assert sparse.search(m.index(), asked(spark, "alpha"), 5).count() == 0 and m.table("chunks").count() == 1
    assert m.index_documents(documents(spark, [(1, "alpha", "a")]))["total_documents"] == 2
    version = m.version()
    assert m.index_documents(documents(spark, [(9, " ", "x")]))["indexed_documents"] == 0 and m.version() == version


def test_one_text_of_an_id_that_a_batch_repeats(spark, tmp_path):
    m = manager(spark, tmp_path / "i")
    docs = documents(spark, [(1, "alpha", "a"), (1, "beta", "a"), (1, "beta", "a")])
    assert m.index_documents(docs)["indexed_documents"] == 1
    row = m.table("registry").first()
    assert m.table("chunks").join(docs, "doc_id").where(F.col("content") == F.col("text")).first().doc_hash == row.doc_hash
    assert m.index_documents(docs.where(F.col("doc_hash") == row.doc_hash))["indexed_documents"] == 0


def test_merges_keep_few_segments(spark, tmp_path):
    m = manager(spark, tmp_path / "i", fanout=2)
    reader, seen, most = None, {}, 0
    for step in range(7):
        rows = [(step * 2 + k, text(6, step * 2 + k), f"s{step}") for k in range(2)]
        m.index_documents(documents(spark, rows))
        seen |= {r[0]: r for r in rows}
        if step == 3:
            m.delete_document(step)
            seen.pop(step)
        held = m.table("registry")
        if m.merge() and reader is None:
            reader = held
            before = len(seen)
        most = max(most, len(m.segments()))
    assert most <= 4 and len(m.segments()) <= 3
    # a reader of the segments before a merge still sees them
    assert reader.count() == before
    assert sorted(r.doc_id for r in m.table("registry").collect()) == sorted(seen)
    queries = asked(spark, "w1 w2 w20", text(10, 3))
    assert key(sparse.search(m.index(), queries, 5)) == plain(spark, list(seen.values()), queries, 5)
    assert sorted(r.doc_id for r in m.table("vectors").collect()) == sorted(seen) == sorted(r.doc_id for r in m.table("words").collect())


@pytest.mark.parametrize("most", [index.MOST_GONE, -1])
def test_small_segments_before_a_larger_one_are_merged(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(index, "MOST_GONE", most)
    m = manager(spark, tmp_path / "i", fanout=2)
    old, new = [(i, text(6, i), "s") for i in range(3)], [(i, text(6, 100 + i), "s") for i in range(1, 9)]
    m.index_documents(documents(spark, old))
    m.index_documents(documents(spark, new))
    before = m.segments()
    assert [s["rows"] for s in before] == [3, 10] and m.merge() == 1
    left = old[:1] + new
    assert [s["rows"] for s in m.segments()] == [9] and m.index().gone is None
    queries = asked(spark, "w1 w2 w20", text(10, 3), old[1][1], new[0][1])
    assert key(sparse.search(m.index(), queries, 5)) == plain(spark, left, queries, 5)
    for name in ("registry", "chunks", "vectors", "words"):
        assert sorted(r.doc_id for r in m.table(name).collect()) == list(range(9))


def test_segments_stay_few_in_any_order(spark, tmp_path):
    m, r = manager(spark, tmp_path / "i", fanout=4), random.Random(5)
    nested = [1]
    for size in (4, 16, 64, 256):
        nested = (nested * 3 + [size]) * 3
    for sizes in (nested, [r.choice([1, 1, 5, 20, 300]) for _ in range(800)], list(range(1, 300)), list(range(300, 1, -1))):
        segments, most = [], 0
        for rows in sizes:
            segments.append({"rows": rows})
            while (start := m._due(segments)) is not None:
                assert len(segments) - start >= 2
                segments[start:] = [{"rows": sum(s["rows"] for s in segments[start:])}]
            most = max(most, len(segments))
        total = sum(sizes)
        assert segments and sum(s["rows"] for s in segments) == total and most <= 3 * (math.floor(math.log(total, 4)) + 1)


def test_index_search_searches_what_was_merged(spark, monkeypatch):
    seen, search = [], sparse.search
    monkeypatch.setattr(sparse, "search", lambda index, *a, **b: seen.append(index) or search(index, *a, **b))
    hits = registered.index_search(spark, "/root/testdata/sf0.001")
    (found,) = seen
    assert found.gone is None and found.rows.select("seq").distinct().count() == 1
    want = registered.bm25_topk(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect())) and hits.count()


def test_a_merge_gives_way_to_a_writer(spark, tmp_path, monkeypatch):
    one, two = manager(spark, tmp_path / "i", fanout=2), manager(spark, tmp_path / "i")
    for i in range(2):
        one.index_documents(documents(spark, [(i, text(4), "s")]))
    state = one._state()
    two.index_documents(documents(spark, [(7, text(4), "s")]))
    monkeypatch.setattr(one, "_state", lambda: (state[0], {**state[1], "segments": list(state[1]["segments"]), "replaced": list(state[1]["replaced"])}))
    assert one.merge() == 0
    with pytest.raises(Changed):
        one.compact()
    assert two.table("registry").count() == 3 and len(two.segments()) == 3


def test_filters_by_bounds(spark, tmp_path):
    engine = Retrieval(manager(spark, tmp_path / "i"))
    m = engine.manager
    for s in ("a", "b", "c"):
        m.index_documents(documents(spark, [(ord(s) * 10 + k, f"{text(5)} leader", f"{s}{k}") for k in range(3)]))
    assert len(m.segments({"source": "b1"})) == 1 and not m.segments({"source": "zz"}) and len(m.segments({"other": 1, "source": None})) == 3
    for mode in ("dense", "sparse", "hybrid"):
        hits = engine.search(asked(spark, "leader"), 5, mode, {"source": "b1"}).collect()
        assert [r.doc_id for r in hits] == [981]
        assert engine.search(asked(spark, "leader"), 5, mode, {"source": "zz"}).count() == 0
    assert not any("chunks" in f for f in m.table("vectors", {"source": "b1"}).inputFiles())
    m.compact()
    assert len(m.segments({"source": "b1"})) == 1 and engine.search(asked(spark, "leader"), 5, "dense", {"source": "b1"}).count() == 1


@pytest.mark.parametrize("metric", dense.METRICS)
def test_clusters_find_what_a_scan_finds(spark, monkeypatch, metric):
    r = np.random.default_rng(4)
    middle = r.normal(size=(6, 8)) * 5
    x = np.concatenate([middle[r.integers(0, 6, 500)] + r.normal(size=(500, 8)) * 0.2, np.tile(middle[0], (60, 1)), np.zeros((3, 8)), r.normal(size=(20, 8))])
    vectors = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(9999, None, 0)], "chunk_id long, embedding array<double>, kind int").repartition(3)
    queries = vectors.where("chunk_id % 23 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    made = clusters.Clusters.of(vectors, metric, 24)
    pairs = spark.sparkContext.accumulator(0)
    assert key(made.search(queries, 5, scored=pairs)) == key(dense.search(vectors, queries, 5, metric))
    assert made.size.sum() == len(x) and (metric == "dot_product" or 0 < pairs.value < 0.6 * len(x) * queries.count())
    assert key(made.search(queries, 5, {"kind": 1}, 0.5)) == key(dense.search(vectors, queries, 5, metric, {"kind": 1}, 0.5))
    assert key(made.search(queries, 700)) == key(dense.search(vectors, queries, 700, metric))
    monkeypatch.setattr(dense, "MOST_NUMBERS", 70)
    monkeypatch.setattr(dense, "BLOCK", 4)
    assert key(made.search(queries, 5)) == key(dense.search(vectors, queries, 5, metric))


def test_clusters_of_nothing_and_of_other_dimensions(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert clusters.Clusters.of(none).search(one).count() == 0
    made = clusters.Clusters.of(one.withColumnRenamed("query_id", "chunk_id"))
    assert made.search(one).first().score == pytest.approx(1) and made.search(one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        made.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")).collect()
    with pytest.raises(ValueError):
        clusters.Clusters.of(none, "manhattan")


def test_texts_are_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        import uuid

        def encode(texts):
            (calls / uuid.uuid4().hex).write_text("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    said = lambda: sorted(t for f in calls.iterdir() for t in f.read_text().split("\n") if t)
    m = manager(spark, tmp_path / "i", embeddings=embeddings.ModelEmbeddings(load, 2), fanout=2)
    m.index_documents(documents(spark, [(1, "alpha", "a"), (2, "beta", "a"), (3, "alpha", "b")]))
    assert said() == ["alpha", "beta"]
    m.index_documents(documents(spark, [(1, "alpha", "a"), (2, "gamma", "a"), (4, "beta", "c")]), force=True)
    assert said() == ["alpha", "beta", "gamma"]
    want = {r.chunk_id: [round(float(x), 5) for x in r.embedding] for r in m.table("vectors").collect()}
    assert sorted(want) == [1, 2, 3, 4] and want[1] == want[3] and want[1][0] == round(5 / 26**0.5, 5)
    m.merge()
    m.compact()
    m.index_documents(documents(spark, [(9, "alpha", "z"), (8, "gamma", "z")]))
    assert said() == ["alpha", "beta", "gamma"] and m.table("vectors").count() == 6


def test_postings_are_counted_in_the_row_and_shuffled_once(spark):
    rows = [(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["a"]), (4, ["z", "z"])]
    tokens = spark.createDataFrame([(i, i * 10, t, len(t)) for i, t in rows], "chunk_id long, doc_id long, tokens array<string>, doc_len int")
    made = sparse.forward(tokens)
    assert {r.chunk_id: [(c.term, c.tf) for c in r.counts] for r in made.collect()} == {1: [("a", 1), ("b", 3), ("c", 1)], 2: [], 3: [("a", 1)], 4: [("z", 2)]}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    flat = made.select("chunk_id", "doc_id", "doc_len", F.inline("counts"))
    columns = ("term", "chunk_id", "doc_id", "doc_len", "tf")
    assert sorted(map(tuple, flat.select(*columns).collect())) == sorted(map(tuple, sparse.postings_of(tokens).select(*columns).collect()))
    for chunks in (None, tokens.select("chunk_id", "doc_len")):
        blocks = sparse.blocked(flat, chunks)
        assert blocks._jdf.queryExecution().sparkPlan().toString().count("rangepartitioning") + blocks._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 1
        assert sorted((r.term, p.chunk_id, p.doc_id, p.doc_len, p.tf) for r in blocks.collect() for p in r.postings) == sorted(map(tuple, flat.select(*columns).collect()))
        assert all(r.df == len(r.postings) and r.most_tf == max(p.tf for p in r.postings) and r.least_len == min(p.doc_len for p in r.postings) for r in blocks.collect())
