"""The index, the adapters with stand-ins for their packages, loaders, evaluation, streaming and the command line."""

import http.server
import importlib
import json
import random
import sys
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.operators import chunking, dense, embeddings, evaluate, generate, rerank, sparse
from tessera.operators.chunking import RecursiveSplitter
from tessera.operators.embeddings import HashingEmbeddings
from tessera.operators.index import Changed, Manager
from tessera.plans.pipeline import Retrieval
from tessera.sources import loaders
from tessera.sources.journal import Journal

TEXTS = ["Raft elects a leader for consensus.", "Paging maps virtual memory to frames.", "Refunds are paid within 30 days."]
META = [{"source": "raft.md"}, {"source": "os.md"}, {"source": "refund.md"}]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


# chunks, against a reading of the rules


def naive_split(text, level, seps, size, overlap, glue_kept):
    """Chunks by joining strings and measuring them."""
    present = [k for k in range(level, len(seps)) if seps[k] in text]
    sep = seps[present[0]] if present else seps[-1]
    finer = present[0] + 1 if present and sep else None
    pieces = []
    for piece in text.split(sep) if sep else text:
        if not piece:
            continue
        if len(piece) < size:
            pieces.append(piece)
        elif finer is not None and finer < len(seps):
            pieces.extend(naive_split(piece, finer, seps, size, overlap, glue_kept))
        else:
            pieces.extend(piece[k : k + size] for k in range(0, len(piece), size - overlap))
    glue, out, first, must = sep if glue_kept else "", [], 0, 1
    while first < len(pieces) or must <= len(pieces):
        end = must
        while end < len(pieces) and len(glue.join(pieces[first : end + 1])) <= size:
            end += 1
        out.append(glue.join(pieces[first:end]).strip())
        if end >= len(pieces):
            break
        first = next((k for k in range(first, end) if len(glue.join(pieces[k:end])) <= overlap), end)
        must = end + 1
    return [c for c in out if c]


def test_chunks_by_brute_force(spark):
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["a", "bb", "ccc dd", ". ", "\n", "\n\n", " ", "? ", "xyzxyzxyzxyz"]) for _ in range(r.randint(0, 40)))
        size = r.randint(2, 40)
        overlap, keep, seps = r.randint(0, size - 1), r.random() < 0.7, r.choice([chunking.SEPARATORS, ("\n\n", " "), (". ",), ("\n", "")])
        assert RecursiveSplitter(size, overlap, seps, keep).split(text) == (naive_split(text, 0, seps, size, overlap, keep) if text else []), (text, size, overlap, keep, seps)


def test_chunks_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = chunking.recursive_chunks(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content", "start_char"))).alias("c")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == sum(bool(t.strip()) for t in texts.values())
    for r in got:
        assert [c.content for c in r.c] == naive_split(texts[r.doc_id], 0, chunking.SEPARATORS, 500, 100, True)
        assert all(texts[r.doc_id].startswith(c.content[:50], c.start_char) or c.start_char >= 0 for c in r.c)


def test_no_separators_are_the_default_ones(spark):
    docs = spark.createDataFrame([(1, "one two. three\n\nfour " * 60)], "doc_id long, text string")
    key = lambda how: [tuple(r) for r in chunking.recursive_chunks(docs, separators=how).orderBy("chunk_index").select("content", "start_char").collect()]
    assert key([]) == key(None) != key([" "])


# the index


def manager(spark, path, **how):
    return Manager(spark, str(path), **{"embeddings": HashingEmbeddings(64)} | how)


def test_index_by_deltas(spark, tmp_path):
    m = manager(spark, tmp_path / "i")
    docs = lambda *rows: loaders.from_table(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert m.index_documents(docs((1, "alpha beta", "a"), (2, "beta gamma", "b"), (3, " ", "c"))) == {"indexed_documents": 2, "skipped_documents": 1, "new_chunks": 2, "total_chunks": 2, "total_documents": 2}
    assert m.index_documents(docs((1, "alpha beta", "a")))["indexed_documents"] == 0
    assert m.index_documents(docs((1, "delta", "a"), (4, "beta delta", "d")))["total_documents"] == 3
    hits = lambda q: [r.chunk_id for r in sparse.search(m.index(), asked(spark, q), 9).orderBy("rank").collect()]
    assert hits("alpha") == [] and sorted(hits("beta")) == ["2_0", "4_0"] and sorted(hits("delta")) == ["1_0", "4_0"]
    whole = sparse.build(m.table("chunks").select("chunk_id", "content"))
    assert (m.index().n, m.index().avgdl) == (whole.n, whole.avgdl)
    assert sorted(map(tuple, m.index().vocab.collect())) == sorted(map(tuple, whole.vocab.collect()))
    assert m.delete_document(2) and not m.delete_document(2) and hits("gamma") == []
    assert m.delete_documents(spark.createDataFrame([(4,), (4,), (77,)], "doc_id long")) == 1
    before = {t: sorted(map(str, m.table(t).collect())) for t in ("registry", "chunks", "vectors", "postings")}
    for _ in range(2):
        m.compact()
        assert {t: sorted(map(str, m.table(t).collect())) for t in before} == before
    assert len(m._state()[1]["segments"]) == 1 and m.stats().first().total_documents == 1
    assert m.index_documents(docs((2, "beta gamma", "b")))["total_documents"] == 2 and hits("gamma") == ["2_0"]


def test_reopened_index(spark, tmp_path):
    words = sparse.BM25(1.2, 0.5, ("raft",))
    first = Retrieval(manager(spark, tmp_path / "i", params=words, metric="euclidean"))
    first.ingest_texts(TEXTS, META)
    again = Retrieval(manager(spark, tmp_path / "i"))
    assert again.manager.params == words and again.manager.metric == "euclidean"
    queries = asked(spark, "raft leader", "raft")
    assert sorted(map(tuple, again.search(queries, 5, "sparse").select("query_id", "chunk_id", "score").collect())) == sorted(map(tuple, first.search(queries, 5, "sparse").select("query_id", "chunk_id", "score").collect()))
    assert again.search(queries, 5, "sparse").where("query_id = 1").count() == 0
    for how in ({"params": sparse.BM25()}, {"metric": "cosine"}):
        with pytest.raises(ValueError, match="was made with"):
            manager(spark, tmp_path / "i", **how)


def test_another_dimension_starts_afresh(spark, tmp_path):
    Retrieval(manager(spark, tmp_path / "i")).ingest_texts(TEXTS, META)
    m = manager(spark, tmp_path / "i", embeddings=HashingEmbeddings(16))
    assert Retrieval(m).ingest_texts(TEXTS[:1], META[:1])["total_documents"] == 1
    assert m.table("vectors").select(F.size("embedding").alias("n")).first().n == 16


def test_replace_by_source(spark, tmp_path):
    engine = Retrieval(manager(spark, tmp_path / "i", replace_by_source=True))
    engine.ingest_texts(TEXTS[:2], META[:2])
    engine.ingest_texts(["Raft replicates a log."], META[:1])
    assert sorted(r.source for r in engine.manager.table("registry").collect()) == ["os.md", "raft.md"]
    assert engine.search(asked(spark, "leader"), 5, "sparse").count() == 0


def test_racing_writers(spark, tmp_path, monkeypatch):
    one, two = manager(spark, tmp_path / "i"), manager(spark, tmp_path / "i")
    state = one._state()
    Retrieval(two).ingest_texts(TEXTS[:1], META[:1])
    monkeypatch.setattr(one, "_state", lambda: state)
    with pytest.raises(Changed):
        Retrieval(one).ingest_texts(TEXTS[1:], META[1:])
    assert two.table("registry").count() == 1


def test_journal(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    assert j.latest() == (0, {}) and j.advance(1, {"a": "é"}) and not j.advance(1, {"a": 2}) and j.latest() == (1, {"a": "é"})


def test_streaming(spark, tmp_path):
    from tessera.streaming.ingest import indexed

    m = manager(spark, tmp_path / "i")
    for k, text in enumerate(TEXTS):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"text": text, "source": f"s{k}"}))
        stream = spark.readStream.schema("text string, source string").json(str(tmp_path / "in"))
        indexed(stream, m, str(tmp_path / "checkpoint")).awaitTermination()
    assert m.table("registry").count() == 3


# evaluation


def test_containing(spark):
    r = random.Random(2)
    word = lambda: r.choice(["aa", "bb", "cc", "dd", "e"])
    texts = [r.choice([" ", "\n"]).join(word() for _ in range(r.randint(1, 30))) for _ in range(120)]
    items = [t[a : a + r.randint(1, 25)] for t in texts[:60] for a in [r.randrange(len(t))]]
    items = [i for i in items if i]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    got = {tuple(x) for x in evaluate.containing(asked(spark, *items), chunks).collect()}
    assert got == {(q, c) for q, i in enumerate(items) for c, t in enumerate(texts) if i in t}


def test_ground_truth_by_name_and_keyword(spark):
    chunks = spark.createDataFrame([("c1", "Leader election", "/d/Raft.md", None), ("c2", "Log", "/d/raft.md", "raft.md"), ("c3", "Leader", "/d/os.md", "OS.md")], "chunk_id string, content string, source string, filename string")
    samples = spark.createDataFrame([(0, [], ["RAFT"], []), (1, [], ["raft", "os"], ["leader"]), (2, ["c3"], [], []), (3, [], ["none"], [])], "query_id long, relevant_chunk_ids array<string>, relevant_doc_names array<string>, relevant_keywords array<string>")
    assert sorted(map(tuple, evaluate.ground_truth(samples, chunks).collect())) == [(0, "c1"), (0, "c2"), (1, "c1"), (1, "c3"), (2, "c3")]


def test_compare_with_latency(spark, tmp_path):
    engine = Retrieval(manager(spark, tmp_path / "i"))
    engine.ingest_texts(TEXTS, META)
    (tmp_path / "e.json").write_text(json.dumps({"name": "n", "description": "d", "samples": [{"query": "who elects a leader", "relevant_doc_names": ["raft"]}, {"query": "when are refunds paid", "relevant_doc_names": ["refund"], "metadata": {"k": "v"}}]}))
    data = loaders.Dataset.load(spark, str(tmp_path / "e.json"))
    rows = engine.compare(data.samples, (1, 5)).collect()
    assert {r.config for r in rows} == {"BM25", "Dense", "Hybrid RRF", "Hybrid + Reranker"} and all(r.avg_latency_ms > 0 and r.recall_5 == 1.0 and r.num_samples == 2 for r in rows)
    assert "avg_latency_ms" in evaluate.table(engine.compare(data.samples, (1, 5)), 5)
    more = data.add_sample("what is paging", ["os"], metadata={"a": "b"})
    more.save(str(tmp_path / "saved"))
    again = loaders.Dataset.load(spark, str(tmp_path / "saved"))
    assert (again.name, again.description) == ("n", "d") and sorted(map(str, again.samples.collect())) == sorted(map(str, more.samples.collect()))
    row = engine.measured(asked(spark, "who elects a leader"), str(tmp_path / "answers"), k=2).first()
    assert row.latency_ms > 0 and row.citations[0].source == "raft.md"
    stages = engine.inspect(asked(spark, "who elects a leader"), 2).orderBy("rank").collect()
    assert stages[0].dense_score is not None and stages[0].bm25_score is not None and stages[0].rrf_score == stages[0].score == stages[0].rerank_score


# adapters


STAND_INS = {
    "sentence_transformers.py": """
import numpy as np
class SentenceTransformer:
    def __init__(self, name, device=None): self.name = name
    def encode(self, texts, normalize_embeddings=True): return np.array([[len(t) + 1.0] + [0.0] * 382 + [1.0] for t in texts])
class CrossEncoder:
    def __init__(self, name, device=None): pass
    def predict(self, pairs): return [float(len(set(q.split()) & set(c.split()))) for q, c in pairs]
""",
    "google/__init__.py": "",
    "google/generativeai/__init__.py": """
class types:
    class GenerationConfig:
        def __init__(self, max_output_tokens, temperature): self.n = max_output_tokens
def configure(api_key): assert api_key == "k"
def embed_content(model, content, task_type): return {"embedding": [3.0, 4.0 if task_type == "retrieval_query" else 0.0]}
class GenerativeModel:
    def __init__(self, model_name, system_instruction, generation_config): self.s = system_instruction
    def generate_content(self, user): return type("R", (), {"text": self.s + "|" + user})()
""",
}


@pytest.fixture(scope="module")
def packages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stand_ins") / "stand_ins.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in STAND_INS.items():
            z.writestr(name, text)
    spark.sparkContext.addPyFile(str(path))
    return str(path)


@pytest.fixture
def stand_ins(packages):
    """Packages that are not here, for the tasks and this process."""
    sys.path.insert(0, packages)
    importlib.invalidate_caches()
    yield
    sys.path[:] = [p for p in sys.path if not p.endswith("stand_ins.zip")]
    importlib.invalidate_caches()
    for name in [m for m in sys.modules if m.split(".")[0] in ("sentence_transformers", "google")]:
        del sys.modules[name]


def test_model_adapters(spark, stand_ins):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    model = embeddings.sentence_transformer()
    got = [r[0] for r in df.select(model.documents("t")).collect()]
    assert model.dimension == 384 == len(got[0]) and np.isclose(got[0][0], 3 / 10**0.5) and np.isclose(got[1][0], 0.5**0.5)
    hosted = embeddings.hosted(api_key="k", dimension=2)
    assert [list(map(float, r)) for r in df.select(hosted.documents("t"), hosted.queries("t")).first()] == [[1.0, 0.0], pytest.approx([0.6, 0.8])]
    hits = spark.createDataFrame([(0, 1, "c1", 1.0, "a b", "b x"), (0, 2, "c2", 0.5, "a b", "b a")], "query_id long, rank int, chunk_id string, score double, query_text string, content string")
    got = [(r.chunk_id, r["rank"], r.rerank_score) for r in rerank.scored(hits, rerank.cross_encoder()).orderBy("rank").collect()]
    assert got == [("c2", 1, 2.0), ("c1", 2, 1.0)]
    prompts = spark.createDataFrame([("s", "u")], "system_prompt string, user_prompt string")
    assert prompts.select(generate.hosted_model(api_key="k")).first()[0] == "s|u"
    with pytest.raises(ValueError):
        generate.hosted_model()


def test_neural_default(spark, tmp_path, stand_ins):
    engine = Retrieval.neural(spark, str(tmp_path / "i"))
    assert engine.manager.embeddings.dimension == 384 and engine.rerank_score is not None


def test_defaults_without_models(spark, tmp_path):
    with pytest.warns(UserWarning, match="hashing"):
        assert isinstance(embeddings.default_embeddings(), HashingEmbeddings)
    with pytest.warns(UserWarning, match="not reranked"):
        assert rerank.default_score() is None


def test_model_server(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": f"{said['model']}: {said['system']} {said['prompt']}"}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    prompts = spark.createDataFrame([("s", "u")], "system_prompt string, user_prompt string")
    assert prompts.select(generate.local_server("m", f"http://127.0.0.1:{server.server_port}")).first()[0] == "m: s u"
    server.shutdown()


# the rest


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def pages(content):
        if b"|" not in content:
            raise RuntimeError("no pages")
        return content.decode().split("|")

    docs, failed = loaders.directory_documents(spark, str(tmp_path), pages=pages)
    assert sorted(r.text for r in docs.collect()) == ["one", "two"]
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in failed.collect()] == [("b.pdf", "RuntimeError: no pages")]
    assert loaders.file_documents(spark, str(tmp_path / "a.pdf"), pages).count() == 2


def test_metadata_filters(spark):
    rows = [('{"a": "x", "n": 1, "b": true, "it\'s": 2, "a.b[0]": "y"}',), ('{"a": null, "n": 2.5}',), ("{}",)]
    df = spark.createDataFrame(rows, "metadata string").withColumn("metadata", F.parse_json("metadata"))
    count = lambda f: df.where(filters.matches(df, f)).count()
    assert [count(f) for f in ({"a": "x"}, {"n": 1}, {"n": 2.5}, {"b": True}, {"a": None}, {"n": "1"}, {"it's": 2}, {"a.b[0]": "y"}, {"a": "x", "n": 1}, {}, None)] == [1, 1, 1, 1, 2, 0, 1, 1, 1, 3, 3]


def test_many_query_passes(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>").repartition(3)
    queries = vectors.withColumnRenamed("chunk_id", "query_id")
    key = lambda df: sorted((q.query_id, q["rank"], q.chunk_id, round(q.score, 9)) for q in df.collect())
    whole = key(dense.search(vectors, queries, 5))
    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "MOST_NUMBERS", 80)
    assert key(dense.search(vectors, queries, 5)) == whole and len(whole) == 300
    norm = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(rank != 1 or int(np.argmax(norm @ norm[q])) == c for q, rank, c, _ in whole)
    assert dense.search(vectors, queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("metric", dense.METRICS)
def test_scores_of_a_large_batch_are_never_held_at_once(metric):
    """Rows are scored some at a time, with the same hits; a third of them are copies, so that ties cross the cuts."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(2)
    x, q = r.normal(size=(6000, 4)), r.normal(size=(1500, 4))
    x[::3], q[:200] = x[0], x[0]
    ids = pa.array(r.permutation(6000))
    tracemalloc.start()
    query, row, value, least = dense.nearest(metric, x, q, ids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # all scores would be 72 MB, several times over
    scores = dense._scores(metric, x, q).T
    for i in (0, 150, 700, 1499):
        want = sorted(range(6000), key=lambda j: (-np.rint(scores[i, j] * 1e9), ids[j].as_py()))[:5]
        assert row[query == i].tolist() == want and least[i] == pytest.approx(scores[i, want[-1]], abs=1e-8)
    assert len(query) == 7500 and np.allclose(value, scores[query, row], atol=1e-9)


def test_batches_are_worked_on_in_parts(spark, monkeypatch):
    """Runs of bounded size, a longer row alone; BM25, chunks and hashed vectors of a batch of several parts are those of a plain way."""
    from tessera.functions import batches

    at = np.array([0, 3, 3, 10, 11, 12, 20])
    assert list(batches.runs(at, 4)) == [(0, 2), (2, 3), (3, 5), (5, 6)] and list(batches.runs(at, 4, 1)) == [(i, i + 1) for i in range(6)]
    assert list(batches.runs(np.array([0]), 4)) == []
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(words[r.integers(0, 300, int(n))]) for n in r.integers(1, 20_000, 60)] + ["w1 w2 w3"] * 3 + [None, ""]
    assert sum(len(t or "") for t in texts) > 2 * chunking.MOST_CHARACTERS
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").coalesce(1)
    asked = spark.createDataFrame([(i, " ".join(words[r.integers(0, 300, 3)])) for i in range(12)], "query_id long, text string")
    found = lambda: sorted((x.query_id, x["rank"], x.chunk_id, round(x.score, 7)) for x in sparse.search(sparse.build(chunks), asked, 4).collect())
    hits = found()
    monkeypatch.setattr(sparse, "MOST_ASKED", 0)
    assert found() == hits and len(hits) == 48
    made = chunking.recursive_chunks(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))).groupBy("doc_id").agg(F.count("content").alias("n")).collect()
    splitter = RecursiveSplitter(500, 100, chunking.SEPARATORS, True)
    assert {x.doc_id: x.n for x in made} == {i: len(splitter.split(t)) for i, t in enumerate(texts) if t}
    vectors = {x.chunk_id: x.v for x in chunks.select("chunk_id", HashingEmbeddings(8).documents("content").alias("v")).collect()}
    assert len(vectors) == len(texts) and all(sum(x * x for x in vectors[i]) == pytest.approx(1 if t else 0) for i, t in enumerate(texts))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tessera.__main__ import main

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "raft.md").write_text(TEXTS[0])
    (tmp_path / "docs" / "os.txt").write_text(TEXTS[1])
    (tmp_path / "e.json").write_text(json.dumps({"samples": [{"query": "leader", "relevant_doc_names": ["raft"]}]}))
    index = ["--index", str(tmp_path / "i"), "--documents", str(tmp_path / "docs")]
    main([*index, "query", "who", "elects", "a", "leader"])
    assert "[Source 1]" in capsys.readouterr().out
    main([*index, "inspect", "leader"])
    main([*index, "benchmark", str(tmp_path / "e.json")])
    main([*index, "ingest", str(tmp_path / "docs" / "os.txt")])
    main([*index, "stats"])
    said = capsys.readouterr().out
    assert "bm25" in said and "avg_latency_ms" in said and "'indexed_documents': 0" in said and "total_documents" in said
    lines = iter(["/help", "/clear", "/mode dense", "leader", "", "/exit"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    main([*index, "interactive"])
    said = capsys.readouterr().out
    assert "other text is a query" in said and "\033[2J" in said


def test_benchmark_makes_each_vector_once(spark, monkeypatch):
    """Of several configurations that use the vector search; the former plan made them several times."""
    from tessera.plans import queries

    seen = spark.sparkContext.accumulator(0)

    class Counting(HashingEmbeddings):
        def documents(self, text):
            def noted(t):
                seen.add(1)
                return t

            return super().documents(F.udf(noted, "string")(text))

    monkeypatch.setattr(queries, "HashingEmbeddings", Counting)
    rows = queries.benchmark_4way(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 4 and seen.value == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


@pytest.mark.parametrize("most", [1 << 22, 1])
def test_containing_by_one_pass_or_by_runs(spark, monkeypatch, most):
    from tessera.operators import patterns

    monkeypatch.setattr(patterns, "BLOCK_BYTES", most)
    chunks = spark.createDataFrame([("a", "x one two  three four five y"), ("b", "one two three four five"), ("c", None), ("d", "")], "chunk_id string, content string")
    samples = spark.createDataFrame([(1, "one two  three four five"), (2, "one two three four fiv"), (3, "o"), (4, None), (5, "nothing of the kind at all"), (6, "three four five")], "query_id long, text string")
    got = sorted(map(tuple, evaluate.containing(samples, chunks).collect()))
    assert got == [(1, "a"), (2, "b"), (3, "a"), (3, "b"), (6, "a"), (6, "b")]


def test_null_vectors_are_no_hits(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, None)], "chunk_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    assert [(r.query_id, r.chunk_id) for r in dense.search(vectors, asked, 3).orderBy("rank").collect()] == [(7, 1), (7, 3)]
    assert dense.search(vectors.where("embedding is null"), asked, 3).count() == 0
