"""Prompts with numbered sources, for every query at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stripped


# The texts of the prompt.
@dataclass(frozen=True)
class PromptTexts:
    context_preamble: str = (
        "You are an expert, highly reliable retrieval-augmented assistant. "
        "You have access to verified reference excerpts extracted directly from authoritative documentation."
    )
    objective: str = (
        "Answer the user's inquiry with 100% factual fidelity based exclusively on the provided Context Sources. "
        "Do not extrapolate, assume, or hallucinate beyond what is explicitly stated in the reference text."
    )
    style: str = "Clear, analytical, structured technical prose using Markdown headers, lists, and bold key terms where appropriate."
    tone: str = "Objective, precise, neutral, and authoritative."
    audience: str = "Technical engineers, software architects, and domain professionals who value verifiable factual accuracy."
    response_format: str = (
        "1. Every factual statement or claim MUST include an inline citation tag: [Source X] (e.g. 'The refund window is 30 days [Source 1].').\n"
        "2. If multiple sources corroborate a claim, combine citations: [Source 1, Source 2].\n"
        "3. If the provided Context Sources do NOT contain enough information to answer the question, state: "
        "'Based on the provided documents, I do not have enough information to answer this question.'\n"
        "4. Never mention source documents that were not provided in the Context Sources."
    )


HEADINGS = ("CONTEXT", "OBJECTIVE", "STYLE", "TONE", "AUDIENCE", "RESPONSE FORMAT & CITATION RULES")
TITLE = "[CO-STAR INSTRUCTION FRAMEWORK]"
NO_SOURCES = "No relevant context sources found."
RULE = "=" * 70
CLOSING = "Please formulate your grounded answer adhering strictly to the CO-STAR response and citation specifications above."


def system_prompt(texts: PromptTexts = PromptTexts()) -> str:
    parts = (texts.context_preamble, texts.objective, texts.style, texts.tone, texts.audience, texts.response_format)
    return "\n\n".join([TITLE, *(f"# {h}\n{t}" for h, t in zip(HEADINGS, parts, strict=True))])


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, query_text, context, citations, n_sources for each of ``queries`` (query_id, text).

    hits have content and chunk_index, and may have filename, source, page and the scores of the stages.
    """
    source = F.coalesce(_or_null(hits, "filename", "string"), _or_null(hits, "source", "string"), F.lit("Unknown"))
    page = _or_null(hits, "page", "int")
    head = F.concat(F.lit("Source "), F.col("rank").cast("string"), F.lit(": "), source, F.coalesce(F.concat(F.lit(", Page "), page.cast("string")), F.lit("")), F.lit(", Chunk "), F.col("chunk_index").cast("string"))
    citation = F.struct(
        F.col("rank").alias("source_id"), F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]")).alias("label"), source.alias("source"),
        F.coalesce(_or_null(hits, "source", "string"), F.lit("")).alias("full_path"), page.alias("page"), F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("chunk_id").cast("string").alias("chunk_id"), F.col("score"), *(_or_null(hits, c, "double").alias(c) for c in ("rerank_score", "dense_score", "bm25_score")),
        F.concat(F.substring("content", 1, 150), F.when(F.length("content") > 150, "...").otherwise("")).alias("preview"),
    )
    block = F.concat(F.lit("--- ["), head, F.lit("] ---\n"), stripped("content"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), citation.alias("citation")))).alias("s"))
    rows = queries.select("query_id", F.col("text").alias("query_text")).join(listed, "query_id", "left")
    joined = F.concat_ws("\n\n", F.transform("s", lambda x: x["block"]))
    return rows.select("query_id", "query_text", F.when(F.col("s").isNull(), NO_SOURCES).otherwise(joined).alias("context"), F.transform("s", lambda x: x["citation"]).alias("citations"), F.coalesce(F.size("s"), F.lit(0)).alias("n_sources"))


def prompts(contexts: DataFrame, texts: PromptTexts = PromptTexts()) -> DataFrame:
    """Adds system_prompt and user_prompt."""
    user = F.concat(F.lit(f"# CONTEXT SOURCES:\n{RULE}\n"), F.col("context"), F.lit(f"\n{RULE}\n\n# USER QUESTION:\n"), F.coalesce("query_text", F.lit("")), F.lit(f"\n\n{CLOSING}"))
    return contexts.withColumn("system_prompt", F.lit(system_prompt(texts))).withColumn("user_prompt", user)
