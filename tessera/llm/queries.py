"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, bpe, decontamination, fingerprints, language, line_dedup, minhash_dedup, quality, ranked_search, secret_scans, substring_dedup, token_counts, url_filters
from tessera.llm.tables import read, shared_folder

#: Tokenizer files that every machine has. `bpe` and `alignment` refuse files that split text otherwise.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_sentences", "n_removed")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secrets(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE, with_ids=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, under two tokenizer versions; then the toxic ones are taken out, and those of low quality are
    counted anew without their exclamation marks. The second batch is sent twice."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    counts = token_counts.counted(docs, {"words": token_counts.words(), "marks": token_counts.marks()}, {"words": token_counts.words(F.replace("text", F.lit("!"), F.lit(""))), "marks": token_counts.marks(F.replace("text", F.lit("!"), F.lit("")))})
    flags = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = counts.join(flags, "doc_id", "left")
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/{token_counts.new_name()}")
    rollup.commit("documents", counts.select(*token_counts.KEY, F.lit("insert").alias("kind"), "n_tokens", F.lit(0).alias("old_tokens")))
    toxic = counts.where("toxic = 1").select(*token_counts.KEY, F.lit("delete").alias("kind"), "n_tokens", F.lit(0).alias("old_tokens"))
    for _ in range(2):
        rollup.commit("toxic", toxic)
    low = counts.where("quality = 0 and coalesce(toxic, 0) != 1")
    rollup.commit("low", low.select(*token_counts.KEY, F.lit("revise").alias("kind"), F.col("revised").alias("n_tokens"), F.col("n_tokens").alias("old_tokens")))
    return rollup.totals()


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.trained(docs, read(spark, sf_dir, "labels"))
    out = quality.scored(docs, field)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE, with_groups=False)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.predicted(docs, language.trained(docs)).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_document_fingerprints, op3_substring_dedup, op4_secret_scans, op5_url_filters, op6_bpe, op7_token_counts, op8_quality_classifier, op9_decontamination, op10_minhash_dedup, op11_tokenizer_alignment, op12_ranked_search, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op3_substring_dedup": SUBSTRING_DEDUP, "op7_token_counts": TOKEN_COUNTS, "op12_ranked_search": RANKED_SEARCH}


LINE_DEDUP = """
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS line, len(s) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
w AS (
  SELECT doc_id, i, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
later AS (
  SELECT doc_id, i, i < n AND trim(line || next) <> ''
    AND row_number() OVER (PARTITION BY line, next, i < n ORDER BY doc_id, i) > 1 AS x FROM w),
gone AS (
  SELECT doc_id, i, x OR coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM later)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, g.n_removed, sha256(g.kept) AS kept_sha256
FROM documents d JOIN (
  SELECT l.doc_id, count(*) FILTER (g.gone)::BIGINT AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (NOT g.gone), '') AS kept
  FROM l JOIN gone g USING (doc_id, i) GROUP BY l.doc_id) g USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?\n]*[ \t]*|[.!?\n]+[ \t]*') AS p FROM documents),
s AS (
  SELECT doc_id, len(p) AS n, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM d),
c AS (
  SELECT *, lower(trim(piece, E' \t\n.!?')) AS t FROM s),
w AS (
  SELECT *, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS w FROM c),
a AS (
  SELECT *, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT *, CASE WHEN w1 >= 25 THEN 1 WHEN i + 1 <= n AND w1 + w2 >= 25 THEN 2
    WHEN i + 2 <= n THEN 3 WHEN i = 1 THEN n ELSE 0 END AS k FROM a),
x AS (
  SELECT doc_id, i, k, row_number() OVER (
      PARTITION BY k, t, CASE WHEN k > 1 THEN t2 END, CASE WHEN k > 2 THEN t3 END ORDER BY doc_id, i) > 1 AS later
  FROM k WHERE k > 0 AND w1 + CASE WHEN k > 1 THEN w2 ELSE 0 END + CASE WHEN k > 2 THEN w3 ELSE 0 END >= 8),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(k)) AS i FROM x WHERE later)
SELECT s.doc_id, coalesce(string_agg(piece, '' ORDER BY s.i) FILTER (g.i IS NULL), '') AS text,
  count(*)::BIGINT AS n_sentences, count(g.i)::BIGINT AS n_removed
FROM s LEFT JOIN gone g USING (doc_id, i) GROUP BY s.doc_id
"""

TOKEN_COUNTS = r"""
WITH t AS (
  SELECT doc_id, source, lang, text, replace(text, '!', '') AS bare FROM documents),
c AS (
  SELECT doc_id, source, lang, 'words' AS tokenizer, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n, len(regexp_extract_all(bare, '[^ \t\n\r]+')) AS revised FROM t
  UNION ALL
  SELECT doc_id, source, lang, 'marks', len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r]')), len(regexp_extract_all(bare, '[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r]')) FROM t),
f AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(CASE WHEN quality = 0 THEN revised ELSE n END)::BIGINT AS n_tokens
FROM c LEFT JOIN f USING (doc_id) WHERE coalesce(toxic, 0) <> 1 GROUP BY source, lang, tokenizer
"""

RANKED_SEARCH = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
