import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics, text
from tessera.operators import chunking, dense, fusion, generate, prompt, sparse
from tessera.operators.chunking import RecursiveSplitter
from tessera.operators.embeddings import HashingEmbeddings
from tessera.operators.index import Manager
from tessera.plans.pipeline import Retrieval
from tessera.sources import loaders


def one(df):
    return [tuple(r) for r in df.collect()]


def test_terms(spark):
    df = spark.createDataFrame([("élan foo-é é-foo don't",)], "t string")
    assert one(df.select(text.terms("t")))[0][0] == ["foo-", "-foo", "don"]


def test_character_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, ""), (3, None)], "doc_id long, text string")
    got = one(chunking.character_chunks(df, 30, 10).orderBy("chunk_index").select("start_char", "end_char"))
    assert got == [(0, 30), (20, 50), (40, 70), (60, 90), (80, 100)]
    with pytest.raises(ValueError):
        chunking.character_chunks(df, 10, 10)


def test_recursive_splitter():
    parts = ["First paragraph is there.", "Second paragraph is here.", "Third one has a few words more."]
    got = list(RecursiveSplitter(35, 5, chunking.SEPARATORS, True).chunks("\n\n".join(parts)))
    assert [c[1] for c in got] == parts and [c[2] for c in got] == [0, 27, 54]
    assert list(RecursiveSplitter(35, 5, chunking.SEPARATORS, True).chunks("  \n ")) == []


def test_bm25(spark):
    rows = [("c1", "Raft consensus protocol handles leader election cleanly"), ("c2", "quantum"), ("c3", "consensus")]
    index = sparse.build(spark.createDataFrame(rows, "chunk_id string, content string"))
    got = one(sparse.search(index, spark.createDataFrame([(0, "raft consensus leader election"), (1, "the")], "query_id long, text string"), 5).select("query_id", "chunk_id"))
    assert got == [(0, "c1"), (0, "c3")]


def test_saturation(spark):
    rows = [("c1", " ".join(["quantum"] * 5)), ("c2", "quantum other words than before")]
    index = sparse.build(spark.createDataFrame(rows, "chunk_id string, content string"))
    got = dict(one(sparse.search(index, spark.createDataFrame([(0, "quantum")], "query_id long, text string")).select("chunk_id", "score")))
    assert got["c2"] < got["c1"] < 4 * got["c2"]


def test_dense(spark):
    rows = [("c1", [1.0, 0.0, 0.0], "a"), ("c2", [0.0, 1.0, 0.0], "b"), ("c3", [0.9, 0.1, 0.0], "a"), ("z", [0.0, 0.0, 0.0], "a")]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, kind string")
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = one(dense.search(vectors, asked, 4).orderBy("rank").select("chunk_id", F.round("score", 6)))
    assert got == [("c1", 1.0), ("c3", 0.993884), ("c2", 0.0), ("z", 0.0)]
    got = dict(one(dense.search(vectors, asked, 4, "euclidean").select("chunk_id", F.round("score", 6))))
    assert got["c3"] == 0.876101 and got["c2"] == 0.414214
    assert one(dense.search(vectors, asked, 9, filters={"kind": "b"}).select("chunk_id")) == [("c2",)]
    assert dense.search(vectors, asked, 9, threshold=1.0).count() == 1
    assert dense.search(vectors, asked, 9, filters={"other": "x"}).count() == 0
    with pytest.raises(ValueError):
        dense.search(vectors, asked, 1, "manhattan")


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")


def test_fusion(spark):
    d, s = hits(spark, [(0, "a", 0.9, 1), (0, "b", 0.1, 2), (1, "x", 0.5, 1)]), hits(spark, [(0, "b", 4.0, 1), (0, "c", 2.0, 2), (2, "y", 3.0, 1)])
    got = {(r.query_id, r.chunk_id): r for r in fusion.fused(d, s).collect()}
    assert math.isclose(got[0, "b"].score, 1 / 61 + 1 / 62) and got[0, "b"].rank == 1
    assert got[1, "x"].score == 0.5 and got[1, "x"].rrf_score is None and got[2, "y"].score == 3.0
    got = {r.chunk_id: r.score for r in fusion.fused(d, s, fusion="linear").where("query_id = 0").collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 0.0}


def test_metrics(spark):
    df = spark.createDataFrame([([2, 4], 2), ([], 0)], "ranks array<int>, n int")
    got = one(df.select(metrics.ndcg("ranks", "n", 4), metrics.precision("ranks", 5), metrics.reciprocal_rank("ranks", "n"), metrics.recall("ranks", "n", 2)))
    assert round(got[0][0], 6) == 0.650921 and got[0][1:] == (0.4, 0.5, 0.5) and got[1] == (1.0, 0.0, 1.0, 1.0)
    df = spark.createDataFrame([("[Source 1] [Source 7]",), ("[Source 1, Source 2]",)], "a string")
    got = one(df.select(metrics.citation_accuracy("a", F.lit(2)).alias("c")).select("c.*"))
    assert got == [(True, 2, 1, 1, 0.5), (False, 0, 0, 0, 0.0)]
    df = spark.createDataFrame([("it is", "words"), (" ", "words"), ("Words fail", "words")], "a string, c string")
    assert [r[0] for r in one(df.select(metrics.faithfulness("a", "c")))] == [1.0, 0.0, 0.5]


def test_hashing_embeddings(spark):
    df = spark.createDataFrame([("raft élan",), ("...",)], "t string")
    got = [r[0] for r in one(df.select(HashingEmbeddings(16).documents("t")))]
    expected = [0.0] * 16
    for h in (3450367768, 3486848868):
        expected[h % 16] += 1
    norm = math.sqrt(sum(x * x for x in expected))
    assert all(math.isclose(a, b / norm, abs_tol=1e-6) for a, b in zip(got[0], expected, strict=True)) and not any(got[1])


def test_mock_answer_without_sources(spark):
    queries = spark.createDataFrame([(0, "why")], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, chunk_id string, rank int, score double, content string, chunk_index int")
    got = prompt.prompts(prompt.context(queries, none)).select(generate.mock_answer()).first()[0]
    assert got == generate.PREFIX + generate.REFUSAL


def test_engine(spark, tmp_path):
    engine = Retrieval(Manager(spark, str(tmp_path / "index"), HashingEmbeddings(64)))
    given = ["Raft elects a leader for consensus.", "Paging maps virtual memory to frames.", "Refunds are paid within 30 days."]
    meta = [{"source": "raft.md"}, {"source": "os.md"}, {"source": "refund.md"}]
    assert engine.ingest_texts(given, meta)["indexed_documents"] == 3
    again = engine.ingest_texts(given, meta)
    assert again["indexed_documents"] == 0 and again["skipped_documents"] == 3
    queries = spark.createDataFrame([(0, "when are refunds paid")], "query_id long, text string")
    row = engine.query(queries, 2).first()
    assert row.citations[0].source == "refund.md" and "[Source 1]" in row.answer
    assert engine.search(queries, 5, "sparse", {"source": "os.md"}).count() == 0
    doc = engine.manager.table("registry").first().doc_id
    assert engine.manager.delete_document(doc) and not engine.manager.delete_document(doc)
    assert engine.manager.stats().first().total_documents == 2


def test_loaders(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\r\ny", newline="")
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"one|  |three")
    (tmp_path / "d.bin").write_bytes(b"no")
    docs, failed = loaders.directory_documents(spark, str(tmp_path), pages=lambda c: c.decode().split("|"))
    got = sorted((r.filename, r.text, r.file_type, r.page) for r in docs.collect())
    assert got == [("a.md", "# x\ny", "markdown", None), ("b.txt", "café", "txt", None), ("c.pdf", "one", "pdf", 1), ("c.pdf", "three", "pdf", 3)]
    assert failed.count() == 0
