"""The registered queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metrics, text
from tessera.operators import chunking, clusters, dense, evaluate, fusion, generate, prompt, rerank, sparse
from tessera.operators.embeddings import HashingEmbeddings
from tessera.operators.index import Manager, fresh
from tessera.sources.loaders import from_table
from tessera.sources.shared import scratch, written

#: Queries of a search over vectors: every row whose id is divisible by this.
EVERY = 20


#: A table is dealt out to all cores, but to no more parts than have so many bytes each.
PART_BYTES = 256 << 10


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of fewer splits than there are cores, and bytes for more, is dealt out. Large tables, and tiny ones, are not shuffled."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(spark.sparkContext.defaultParallelism, size // PART_BYTES)
    return table.repartition(parts) if table.rdd.getNumPartitions() < parts else table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", "source", F.lit(0).alias("chunk_index"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def tokenize_stats(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(text.terms("text")).cast("long").alias("n_terms"), F.size(F.array_distinct(text.terms("text"))).cast("long").alias("n_distinct"), F.size(text.word_runs("text")).cast("long").alias("n_words"))


def content_hashes(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_hash("source", "text").alias("doc_hash"), text.document_key("source", "text").alias("doc_key"), text.chunk_hash("text").alias("chunk_hash"))


def char_chunks(spark, sf_dir):
    out = chunking.character_chunks(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "chunk_hash")


def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("content")


def postings(spark, sf_dir):
    return sparse.postings_of(sparse.lengths(_chunks(spark, sf_dir))).select("term", "chunk_id", "tf", F.col("doc_len").cast("long").alias("doc_len"))


def vocab_idf(spark, sf_dir):
    return _six(sparse.build(_chunks(spark, sf_dir)).vocab, "idf")


def corpus_stats(spark, sf_dir):
    return _six(sparse.stats_of(sparse.lengths(_chunks(spark, sf_dir))), "avgdl")


def _bm25(spark, sf_dir, k=10, filters=None):
    chunks = _chunks(spark, sf_dir)
    return sparse.search(sparse.build(chunks), _items(spark, sf_dir), k, chunks, filters)


def bm25_topk(spark, sf_dir):
    return _six(_bm25(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score"), "score")


def bm25_filtered(spark, sf_dir):
    return _six(_bm25(spark, sf_dir, filters={"lang": "en"}).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score"), "score")


def _vectors(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return vectors, vectors.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


def _dense(spark, sf_dir, k=10, **how):
    vectors, asked = _vectors(spark, sf_dir)
    return dense.search(vectors, asked, k, **how)


def _shown(hits: DataFrame) -> DataFrame:
    return _six(hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score"), "score")


def dense_cosine(spark, sf_dir):
    return _shown(_dense(spark, sf_dir))


def dense_dot(spark, sf_dir):
    return _shown(_dense(spark, sf_dir, metric="dot_product"))


def dense_euclidean(spark, sf_dir):
    return _shown(_dense(spark, sf_dir, metric="euclidean"))


def dense_threshold(spark, sf_dir):
    return _shown(_dense(spark, sf_dir, threshold=0.3))


def dense_filtered(spark, sf_dir):
    return _shown(_dense(spark, sf_dir, filters={"label": 3}))


def _pruned(spark, sf_dir, metric):
    vectors, asked = _vectors(spark, sf_dir)
    return _shown(clusters.Clusters.of(vectors, metric).search(asked, 10))


def dense_pruned_cosine(spark, sf_dir):
    """The same hits as dense_cosine, from clusters whose bounds reach them."""
    return _pruned(spark, sf_dir, "cosine")


def dense_pruned_dot(spark, sf_dir):
    return _pruned(spark, sf_dir, "dot_product")


def dense_pruned_euclidean(spark, sf_dir):
    return _pruned(spark, sf_dir, "euclidean")


def hashing_embeddings(spark, sf_dir):
    vector = HashingEmbeddings(64).documents("text")
    return _read(spark, sf_dir, "documents").select("doc_id", F.transform(vector, lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


def _sides(spark, sf_dir):
    """Vector hits of every 20th vector, keyword hits of the benchmark item of the same number."""
    most = fusion.candidates(10)
    items = _items(spark, sf_dir).withColumn("query_id", F.col("query_id") * EVERY)
    chunks = _chunks(spark, sf_dir)
    return _dense(spark, sf_dir, most), sparse.search(sparse.build(chunks), items, most)


def _fused(spark, sf_dir, kind):
    out = fusion.fused(*_sides(spark, sf_dir), 10, kind)
    return _six(out.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "dense_score", "bm25_score", "rrf_score"), "score", "dense_score", "bm25_score", "rrf_score")


def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, "rrf")


def linear_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, "linear")


def _with_content(spark, sf_dir, hits):
    """Hits are a few for each query, so these go to the chunks up to a checked number of queries."""
    few = _read(spark, sf_dir, "benchmark").count() <= sparse.MOST_ASKED // 100
    return _chunks(spark, sf_dir).join(F.broadcast(hits) if few else hits, "chunk_id").join(_items(spark, sf_dir).withColumnRenamed("text", "query_text"), "query_id")


def _reranked(out):
    return _six(out.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "rerank_score"), "score", "rerank_score")


def rerank_passthrough(spark, sf_dir):
    return _reranked(rerank.passthrough(_bm25(spark, sf_dir, 20), 5))


def rerank_scored(spark, sf_dir):
    hits = _with_content(spark, sf_dir, _bm25(spark, sf_dir, 20))
    return _reranked(rerank.scored(hits, metrics.faithfulness("query_text", "content"), 5))


def ground_truth(spark, sf_dir):
    """Documents that hold a benchmark text."""
    return evaluate.containing(_items(spark, sf_dir), _chunks(spark, sf_dir))


def ground_truth_names(spark, sf_dir):
    """Every benchmark item names a source, and has a keyword, its third word."""
    names = F.array(F.concat(F.lit("SRC"), (F.col("query_id") % 20).cast("string")))
    samples = _items(spark, sf_dir).withColumns({"relevant_chunk_ids": F.array().cast("array<string>"), "relevant_doc_names": names, "relevant_keywords": F.array(F.get(F.split("text", " "), F.lit(2)))})
    return evaluate.ground_truth(samples, _chunks(spark, sf_dir)).select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"))


def eval_per_query(spark, sf_dir):
    out = evaluate.per_query(_bm25(spark, sf_dir, 10), ground_truth(spark, sf_dir))
    return _six(out, *(c for c in out.columns if c not in ("query_id", "n_relevant")))


def eval_summary(spark, sf_dir):
    return evaluate.summary(evaluate.per_query(_bm25(spark, sf_dir, 10), ground_truth(spark, sf_dir)))


def benchmark_4way(spark, sf_dir):
    """Keyword, vector, fused and reranked, over the benchmark items."""
    items, chunks = _items(spark, sf_dir), _chunks(spark, sf_dir)
    model, index = HashingEmbeddings(64), sparse.build(chunks)
    most = fusion.candidates(20)
    # several configurations are made of each: written, so that each search runs once
    near = written(dense.search(chunks.select("chunk_id", model.documents("content").alias("embedding")), items.select("query_id", model.queries("text").alias("embedding")), most))
    key = written(sparse.search(index, items, most))
    both = written(fusion.fused(near, key, 20))
    again = rerank.scored(_with_content(spark, sf_dir, both), metrics.faithfulness("query_text", "content"), 10)
    first = lambda hits: hits.where(F.col("rank") <= 10)
    return evaluate.compared({"BM25": first(key), "Dense": first(near), "Hybrid RRF": first(both), "Hybrid + Reranker": again}, ground_truth(spark, sf_dir))


def _documents(spark, sf_dir):
    return from_table(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def incremental_upsert(spark, sf_dir):
    """The labelled documents are known; then all come."""
    docs = _documents(spark, sf_dir)
    known = docs.join(_read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return fresh(docs, known).select("doc_id", "doc_hash")


def _manager(spark: SparkSession, no_blanks: bool = False) -> Manager:
    """An index of whole documents, or of those that have any text."""
    chunk = lambda docs: docs.where("btrim(text, ' \n') <> ''" if no_blanks else "true").select("doc_id", F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit(0).alias("chunk_index"))
    return Manager(spark, scratch(spark), HashingEmbeddings(64), chunk)


def index_upsert(spark, sf_dir):
    """The index first holds former versions of the labelled documents; then all documents come, twice."""
    docs, manager = _documents(spark, sf_dir), _manager(spark)
    labelled = docs.join(_read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    manager.index_documents(from_table(labelled.withColumn("text", F.reverse("text"))))
    manager.index_documents(docs)
    manager.index_documents(docs)
    return manager.table("registry").select("doc_id", "doc_hash", F.col("chunk_count").cast("long").alias("chunk_count"), "terms")


def index_search(spark, sf_dir):
    """Keyword search of an index that held former versions of the labelled documents, and was merged: by blocks of postings with bounds."""
    docs, manager = _documents(spark, sf_dir), _manager(spark)
    labelled = docs.join(_read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    manager.index_documents(from_table(labelled.withColumn("text", F.reverse("text"))))
    manager.index_documents(docs)
    manager.fanout = 2
    manager.merge()
    return _shown(sparse.search(manager.index(), _items(spark, sf_dir), 10))


def index_vocab(spark, sf_dir):
    """The vocabulary, by signed differences, of an index from which the toxic documents were deleted."""
    return _six(_without_toxic(spark, sf_dir).index().vocab, "idf")


def index_blanked(spark, sf_dir):
    """All documents come, then the labelled ones again with a blank text: these go."""
    docs, manager = _documents(spark, sf_dir), _manager(spark, True)
    manager.index_documents(docs)
    labelled = docs.join(_read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    manager.index_documents(from_table(labelled.withColumn("text", F.lit(" \n"))))
    return manager.table("registry").select("doc_id", "doc_hash", "terms")


def _without_toxic(spark, sf_dir):
    manager = _manager(spark)
    manager.index_documents(_documents(spark, sf_dir))
    manager.delete_documents(_read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return manager


def index_delete(spark, sf_dir):
    """Keyword search of an index from which the toxic documents were deleted."""
    return _shown(sparse.search(_without_toxic(spark, sf_dir).index(), _items(spark, sf_dir), 10))


def index_compacted(spark, sf_dir):
    """The index's own statistics, after the toxic documents were deleted and one segment was made of all."""
    manager = _without_toxic(spark, sf_dir)
    manager.compact()
    return manager.stats().select("total_documents", "total_chunks", "bm25_vocabulary_size", "bm25_avg_doc_len")


def delete_documents(spark, sf_dir):
    """Corpus statistics by language without the toxic documents."""
    gone = _read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")).distinct()
    left = _chunks(spark, sf_dir).join(gone, "chunk_id", "left_anti")
    tokens = left.select("chunk_id", "lang", F.size(text.terms("content")).alias("doc_len"))
    return tokens.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("doc_len"), 6).alias("avgdl"))


def _contexts(spark, sf_dir):
    hits = _with_content(spark, sf_dir, _bm25(spark, sf_dir, 5)).drop("query_text")
    return prompt.context(_items(spark, sf_dir), hits)


def format_context(spark, sf_dir):
    return _contexts(spark, sf_dir).select("query_id", "context", F.col("n_sources").cast("long").alias("n_sources"), F.array_join(F.transform("citations", lambda c: F.concat(c["label"], F.lit(" "), c["source"], F.lit(" "), c["chunk_id"], F.lit(" "), c["preview"])), "|").alias("cited"))


def build_prompt(spark, sf_dir):
    return prompt.prompts(_contexts(spark, sf_dir)).select("query_id", F.sha2("user_prompt", 256).alias("user_sha256"), F.sha2("system_prompt", 256).alias("system_sha256"))


def mock_answers(spark, sf_dir):
    return prompt.prompts(_contexts(spark, sf_dir)).select("query_id", generate.mock_answer().alias("answer"))


def citation_accuracy(spark, sf_dir):
    """Every turn cites the source of its own number, of three sources."""
    turns = _read(spark, sf_dir, "conversations").withColumn("answer", F.concat("text", F.lit(" [Source "), F.col("turn").cast("string"), F.lit("] [Source 1, Source 2]")))
    out = turns.select("conv_id", "turn", metrics.citation_accuracy("answer", F.lit(3)).alias("c")).select("conv_id", "turn", "c.*")
    return out.withColumns({c: F.col(c).cast("long") for c in ("total_citations", "valid_citations", "invalid_citations")})


def faithfulness(spark, sf_dir):
    """Every turn against the one before."""
    turns = _read(spark, sf_dir, "conversations")
    before = turns.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("context"))
    out = turns.join(before, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.round(metrics.faithfulness("text", "context"), 6).alias("faithfulness"))


def index_stats(spark, sf_dir):
    index = sparse.build(_chunks(spark, sf_dir))
    stats = index.corpus_stats.select(F.col("n").alias("total_documents"), F.round("avgdl", 2).alias("bm25_avg_doc_len"))
    return stats.withColumn("bm25_vocabulary_size", F.lit(index.vocab.count()).cast("long"))


NAMES = (
    tokenize_stats, content_hashes, char_chunks, recursive_chunks, postings, vocab_idf, corpus_stats, bm25_topk, bm25_filtered, hashing_embeddings,
    dense_cosine, dense_dot, dense_euclidean, dense_threshold, dense_filtered, dense_pruned_cosine, dense_pruned_dot, dense_pruned_euclidean, rrf_fusion, linear_fusion, rerank_passthrough, rerank_scored, ground_truth,
    ground_truth_names, index_upsert, index_delete, index_compacted, index_search, index_vocab, index_blanked, eval_per_query, eval_summary, benchmark_4way, incremental_upsert, delete_documents, format_context, build_prompt, mock_answers, citation_accuracy, faithfulness, index_stats,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


# The SQL, from parts that several queries share.


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "[" + ",".join(map(_quoted, text.STOPWORDS)) + "]"
FUNCTION = "[" + ",".join(map(_quoted, text.FUNCTION_WORDS)) + "]"


def _ascii(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', 'Z', 'g')"


def _terms(c: str) -> str:
    return rf"list_filter(regexp_extract_all({_ascii(c)}, '\b[a-z0-9_-]+\b'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def _plain(c: str) -> str:
    return rf"regexp_extract_all({_ascii(c)}, '\b[a-z]{{3,}}\b')"


def _faithful(a: str, c: str) -> str:
    said = f"list_filter({_plain(a)}, lambda w: NOT list_contains({FUNCTION}, w))"
    return f"CASE WHEN trim({a}) = '' OR trim({c}) = '' THEN 0.0 WHEN len({said}) = 0 THEN 1.0 ELSE len(list_filter({said}, lambda w: list_contains({_plain(c)}, w))) / len({said}) END"


TOKENS = f"tok AS (SELECT doc_id AS chunk_id, lang, source, text AS content, {_terms('text')} AS terms FROM documents)"
INDEX = f"""{TOKENS},
post AS (SELECT term, chunk_id, doc_len, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS doc_len, unnest(terms) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avgdl FROM tok),
vocab AS (SELECT term, count(*) AS df, greatest(1e-6, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1)) AS idf FROM post, stats GROUP BY term)"""


def _bm25_sql(k: int, where: str = "true", query_id: str = "item_id") -> str:
    return f"""{INDEX},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT {query_id} AS query_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))) AS score
  FROM asked JOIN vocab USING (term) JOIN post USING (term), stats
  WHERE chunk_id IN (SELECT chunk_id FROM tok WHERE {where}) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored) WHERE rank <= {k})"""


def _dense_sql(score: str, k: int = 10, where: str = "true") -> str:
    return f"""near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {score} AS score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % {EVERY} = 0) q,
    (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) v WHERE {where}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM near) WHERE rank <= {k})"""


COSINE = "list_cosine_similarity(q.e, v.e)"
HITS = "SELECT query_id, rank, chunk_id, round(score, 6) AS score"
CONTEXT = _bm25_sql(5) + """,
shown AS (SELECT query_id, rank, chunk_id, source, content,
  '--- [Source ' || rank || ': ' || source || ', Chunk 0] ---' || chr(10) || trim(content, E' \\t\\n\\r') AS block,
  '[Source ' || rank || '] ' || source || ' ' || chunk_id || ' ' || substring(content, 1, 150) || CASE WHEN length(content) > 150 THEN '...' ELSE '' END AS cite
  FROM hits JOIN tok USING (chunk_id)),
listed AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_sources, string_agg(cite, '|' ORDER BY rank) AS cited FROM shown GROUP BY query_id),
contexts AS (SELECT b.item_id AS query_id, b.text AS query_text, coalesce(context, 'No relevant context sources found.') AS context, coalesce(n_sources, 0) AS n_sources, cited
  FROM benchmark b LEFT JOIN listed l ON l.query_id = b.item_id)"""
TRUTH = "truth AS (SELECT DISTINCT item_id AS query_id, doc_id AS chunk_id FROM documents d, benchmark b WHERE contains(d.text, b.text))"


def _fused_sql(score: str, order: str, rrf: str) -> str:
    return f"""WITH {_dense_sql(COSINE, 30)}, {_bm25_sql(30, query_id=f'item_id * {EVERY}')}, {_fusion(score, order, rrf)}
{HITS}, round(ds, 6) AS dense_score, round(bs, 6) AS bm25_score, round(rrf_score, 6) AS rrf_score FROM final WHERE rank <= 10"""


def _fusion(score: str, order: str, rrf: str) -> str:
    """From dense and hits to final."""
    return f"""both_ AS (SELECT query_id, chunk_id, d.score AS ds, d.rank AS dr, s.score AS bs, s.rank AS br FROM dense d FULL JOIN hits s USING (query_id, chunk_id)),
sized AS (SELECT *, count(dr) OVER w AS nd, count(br) OVER w AS nb, min(ds) OVER w AS d0, max(ds) OVER w AS d1, min(bs) OVER w AS b0, max(bs) OVER w AS b1 FROM both_ WINDOW w AS (PARTITION BY query_id)),
mixed AS (SELECT *, nd > 0 AND nb > 0 AS two, {score} AS m FROM sized),
final AS (SELECT query_id, chunk_id, CASE WHEN two THEN m ELSE coalesce(ds, bs) END AS score, ds, bs, {rrf} AS rrf_score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT two THEN coalesce(dr, br) END, round(CASE WHEN two THEN m ELSE coalesce(ds, bs) END, 9) DESC, {order} chunk_id) AS rank FROM mixed)"""


RRF = ("coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + br), 0)", "dr NULLS LAST, br NULLS LAST,", "CASE WHEN two THEN m END")
#: The checksum's table of 256, and from it the bucket of each word w of the table u.
CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda k: ('0x' || substring(hex(encode(w)), (2 * k + 1)::INT, 2))::BIGINT) AS b FROM u),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 64 AS d FROM bytes, crc)"""


def _embedded(source: str) -> str:
    """vectors (id, e) of the words of ``source``, a query of (id, text)."""
    return rf"""given AS ({source}),
said AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM given), u AS (SELECT DISTINCT w FROM said), {CRC},
counts AS (SELECT id, d, count(*) AS c FROM said JOIN buckets USING (w) GROUP BY ALL), norms AS (SELECT id, sqrt(sum(c * c)) AS norm FROM counts GROUP BY id),
vectors AS (SELECT g.id, list(coalesce(c / norm, 0.0)::FLOAT ORDER BY r.d) AS e
  FROM given g CROSS JOIN range(64) r(d) LEFT JOIN norms USING (id) LEFT JOIN counts c ON c.id = g.id AND c.d = r.d GROUP BY g.id)"""


def _four_ways_sql() -> str:
    # documents as d1, d2, ..., items as q1, q2, ...
    vectors = _embedded("SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark")
    config = lambda name, hits: f"SELECT '{name}' AS config, query_id, chunk_id, rank FROM {hits} WHERE rank <= 10"
    return f"""WITH {vectors}, side AS (SELECT substring(id, 1, 1) AS s, substring(id, 2)::BIGINT AS id, e::DOUBLE[] AS e, list_aggregate(e, 'sum') = 0 AS none FROM vectors),
near AS (SELECT q.id AS query_id, v.id AS chunk_id, CASE WHEN q.none OR v.none THEN 0.0 ELSE {COSINE} END AS score FROM side q, side v WHERE q.s = 'q' AND v.s = 'd'),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM near) WHERE rank <= 60),
{_bm25_sql(60)}, {_fusion(*RRF)},
scored_again AS (SELECT f.query_id, f.chunk_id, f.rank AS before, {_faithful('b.text', 'd.text')} AS r FROM final f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 20),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 9) DESC, before) AS rank FROM scored_again),
configs AS ({config('BM25', 'hits')} UNION ALL {config('Dense', 'dense')} UNION ALL {config('Hybrid RRF', 'final')} UNION ALL {config('Hybrid + Reranker', 'again')}),
{TRUTH}, {_metrics_sql('config', '(SELECT * FROM truth CROSS JOIN (SELECT DISTINCT config FROM configs))', 'configs')}
SELECT config, count(*) AS num_samples, {MEANS} FROM judged GROUP BY config"""


def _scaled(c: str) -> str:
    return f"coalesce(CASE WHEN {c}1 - {c}0 > 1e-6 THEN ({c}s - {c}0) / ({c}1 - {c}0) ELSE 0.0 END, 0.0)"


def _metrics_sql(by: str = "", truth: str = "truth", hits: str = "hits") -> str:
    cols = ["coalesce(1.0 / list_min(ranks), 0.0) AS mrr"]
    for k in evaluate.KS:
        hit = f"len(list_filter(ranks, lambda r: r <= {k}))"
        gain = f"coalesce(list_sum(list_transform(list_filter(ranks, lambda r: r <= {k}), lambda r: 1.0 / log2(r + 1))), 0.0)"
        ideal = f"list_sum(list_transform(range(1, least(n_relevant, {k}) + 1), lambda r: 1.0 / log2(r + 1)))"
        cols += [f"{hit} / n_relevant AS recall_{k}", f"{hit} / {k}.0 AS precision_{k}", f"CASE WHEN {hit} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_rate_{k}", f"{gain} / {ideal} AS ndcg_{k}"]
    by = f", {by}" if by else ""
    return f"""judged AS (SELECT query_id{by}, n_relevant, {', '.join(cols)} FROM (
  SELECT query_id{by}, count(*) AS n_relevant, coalesce(list(rank) FILTER (rank IS NOT NULL), []) AS ranks FROM {truth} t LEFT JOIN {hits} h USING (query_id, chunk_id{by}) GROUP BY query_id{by}))"""


def _without_toxic_sql(sql: str) -> str:
    return sql.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")


METRICS = ["mrr", *(f"{m}_{k}" for k in evaluate.KS for m in ("recall", "precision", "hit_rate", "ndcg"))]
EACH = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRICS)


def oracle_sql() -> dict[str, str]:
    rerank_score = _faithful("b.text", "d.text")
    return {
        "tokenize_stats": rf"SELECT doc_id, len({_terms('text')})::BIGINT AS n_terms, len(list_distinct({_terms('text')}))::BIGINT AS n_distinct, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))::BIGINT AS n_words FROM documents",
        "content_hashes": "SELECT doc_id, sha256(source || ':' || text) AS doc_hash, substring(sha256(source || ':' || text), 1, 16) AS doc_key, substring(sha256(text), 1, 16) AS chunk_hash FROM documents",
        "char_chunks": "SELECT doc_id, i AS chunk_index, doc_id || '_' || i AS chunk_id, i * 400 AS start_char, least(i * 400 + 500, length(text)) AS end_char, substring(sha256(substring(text, i * 400 + 1, 500)), 1, 16) AS chunk_hash FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 500 THEN 1 ELSE 1 + ceil((length(text) - 500) / 400.0)::BIGINT END)) AS i FROM documents)",
        "postings": f"WITH {INDEX} SELECT term, chunk_id, tf, doc_len FROM post",
        "vocab_idf": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "corpus_stats": f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
        "bm25_topk": f"WITH {_bm25_sql(10)} {HITS} FROM hits",
        "bm25_filtered": f"WITH {_bm25_sql(10, where='''lang = 'en' ''')} {HITS} FROM hits",
        "dense_cosine": f"WITH {_dense_sql(COSINE)} {HITS} FROM dense",
        "dense_dot": f"WITH {_dense_sql('list_inner_product(q.e, v.e)')} {HITS} FROM dense",
        "dense_euclidean": f"WITH {_dense_sql('1 / (1 + list_distance(q.e, v.e))')} {HITS} FROM dense",
        "dense_threshold": f"WITH {_dense_sql(COSINE, where=f'{COSINE} >= 0.3')} {HITS} FROM dense",
        "dense_filtered": f"WITH {_dense_sql(COSINE, where='v.label = 3')} {HITS} FROM dense",
        "dense_pruned_cosine": f"WITH {_dense_sql(COSINE)} {HITS} FROM dense",
        "dense_pruned_dot": f"WITH {_dense_sql('list_inner_product(q.e, v.e)')} {HITS} FROM dense",
        "dense_pruned_euclidean": f"WITH {_dense_sql('1 / (1 + list_distance(q.e, v.e))')} {HITS} FROM dense",
        "rrf_fusion": _fused_sql(*RRF),
        "linear_fusion": _fused_sql(f"0.5 * {_scaled('d')} + 0.5 * {_scaled('b')}", "", "NULL::DOUBLE"),
        "rerank_passthrough": f"WITH {_bm25_sql(5)} {HITS}, round(score, 6) AS rerank_score FROM hits",
        "rerank_scored": f"WITH {_bm25_sql(20)}, again AS (SELECT query_id, rank AS before, chunk_id, score, {rerank_score} AS rerank_score FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id), final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, before) AS rank FROM again) {HITS}, round(rerank_score, 6) AS rerank_score FROM final WHERE rank <= 5",
        "ground_truth": f"WITH {TRUTH} SELECT * FROM truth",
        "eval_per_query": f"WITH {_bm25_sql(10)}, {TRUTH}, {_metrics_sql()} SELECT query_id, n_relevant, {EACH} FROM judged",
        "eval_summary": f"WITH {_bm25_sql(10)}, {TRUTH}, {_metrics_sql()} SELECT count(*) AS num_samples, {MEANS} FROM judged",
        "ground_truth_names": "SELECT DISTINCT item_id AS query_id, doc_id AS chunk_id FROM documents d, benchmark b WHERE contains(lower(d.source), 'src' || (item_id % 20)) AND contains(lower(d.text), lower(string_split(b.text, ' ')[3]))",
        "hashing_embeddings": f"WITH {_embedded('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, list_transform(e, lambda x: round(x::DOUBLE, 5)) AS embedding FROM vectors",
        "benchmark_4way": _four_ways_sql(),
        "index_upsert": f"WITH {TOKENS} SELECT chunk_id AS doc_id, sha256(source || ':' || content) AS doc_hash, 1::BIGINT AS chunk_count, len(terms)::BIGINT AS terms FROM tok",
        "index_delete": f"WITH {_without_toxic_sql(_bm25_sql(10))} {HITS} FROM hits",
        "index_compacted": f"WITH {_without_toxic_sql(INDEX)} SELECT n AS total_documents, n AS total_chunks, (SELECT count(*) FROM vocab) AS bm25_vocabulary_size, round(avgdl, 2) AS bm25_avg_doc_len FROM stats",
        "index_search": f"WITH {_bm25_sql(10)} {HITS} FROM hits",
        "index_vocab": f"WITH {_without_toxic_sql(INDEX)} SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "index_blanked": f"WITH {TOKENS} SELECT chunk_id AS doc_id, sha256(source || ':' || content) AS doc_hash, len(terms)::BIGINT AS terms FROM tok WHERE trim(content, E' \\n') <> '' AND chunk_id NOT IN (SELECT doc_id FROM labels)",
        "incremental_upsert": "SELECT doc_id, sha256(source || ':' || text) AS doc_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "delete_documents": f"WITH {TOKENS} SELECT lang, count(*) AS n, round(avg(len(terms)), 6) AS avgdl FROM tok WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang",
        "format_context": f"WITH {CONTEXT} SELECT query_id, context, n_sources, cited FROM contexts",
        "build_prompt": f"WITH {CONTEXT} SELECT query_id, sha256('# CONTEXT SOURCES:' || chr(10) || repeat('=', 70) || chr(10) || context || chr(10) || repeat('=', 70) || chr(10) || chr(10) || '# USER QUESTION:' || chr(10) || query_text || chr(10) || chr(10) || {_quoted(prompt.CLOSING)}) AS user_sha256, sha256({_quoted(prompt.system_prompt())}) AS system_sha256 FROM contexts",
        "mock_answers": f"WITH {CONTEXT}, l AS (SELECT query_id, list_filter(flatten(list(list_transform(string_split(content, chr(10)), lambda x: trim(x, E' \\t\\r')) ORDER BY rank)), lambda x: x <> '')[1:3] AS s FROM shown GROUP BY query_id), q AS (SELECT query_id, array_to_string(s, ' ') AS s FROM l WHERE len(s) > 0) SELECT c.query_id, '{generate.PREFIX}' || CASE WHEN s IS NULL THEN '{generate.REFUSAL}' ELSE '{generate.QUOTE}' || substring(s, 1, 200) || CASE WHEN length(s) > 200 THEN '...' ELSE '' END || ' [Source 1].' END AS answer FROM contexts c LEFT JOIN q USING (query_id)",
        "citation_accuracy": r"WITH a AS (SELECT conv_id, turn, regexp_extract_all(text || ' [Source ' || turn || '] [Source 1, Source 2]', '\[Source\s+(\d+)\]', 1) AS c FROM conversations), v AS (SELECT conv_id, turn, len(c) AS t, len(list_filter(c, lambda x: x::BIGINT BETWEEN 1 AND 3)) AS v FROM a) SELECT conv_id, turn, t > 0 AS has_citations, t::BIGINT AS total_citations, v::BIGINT AS valid_citations, (t - v)::BIGINT AS invalid_citations, CASE WHEN t > 0 THEN v / t ELSE 0.0 END AS citation_accuracy FROM v",
        "faithfulness": f"WITH b AS (SELECT conv_id, turn + 1 AS turn, min(text) AS context FROM conversations GROUP BY ALL) SELECT conv_id, turn, round({_faithful('text', 'context')}, 6) AS faithfulness FROM conversations JOIN b USING (conv_id, turn)",
        "index_stats": f"WITH {INDEX} SELECT n AS total_documents, round(avgdl, 2) AS bm25_avg_doc_len, (SELECT count(*) FROM vocab) AS bm25_vocabulary_size FROM stats",
    }
