"""Ranking and answer metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import FUNCTION_WORDS, _col, cited_sources, let, plain_words, stripped

# The ranking metrics take an array of the 1-based ranks of relevant results, and the number of relevant items.


def hits(ranks: Column | str, k: int | None) -> Column:
    ranks = _col(ranks)
    return F.size(ranks if k is None else F.filter(ranks, lambda r: r <= k))


def recall(ranks: Column | str, n_relevant: Column | str, k: int = 5) -> Column:
    n = _col(n_relevant)
    return F.when(n == 0, 1.0).otherwise(hits(ranks, k) / F.greatest(n, F.lit(1)))


def precision(ranks: Column | str, k: int = 5) -> Column:
    return hits(ranks, k) / F.lit(float(k)) if k else F.lit(0.0)


def hit_rate(ranks: Column | str, n_relevant: Column | str, k: int = 5) -> Column:
    return F.when(_col(n_relevant) == 0, 1.0).otherwise((hits(ranks, k) > 0).cast("double"))


def reciprocal_rank(ranks: Column | str, n_relevant: Column | str) -> Column:
    first = F.array_min(_col(ranks))
    return F.when(_col(n_relevant) == 0, 1.0).otherwise(F.coalesce(F.lit(1.0) / first, F.lit(0.0)))


def _discounted(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda a, r: a + F.lit(1.0) / F.log2(r + F.lit(1.0)))


def ndcg(ranks: Column | str, n_relevant: Column | str, k: int = 5) -> Column:
    n, ranks = _col(n_relevant).cast("int"), _col(ranks)
    if not k:
        return F.when(n == 0, 1.0).otherwise(0.0)
    ideal = _discounted(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1))))
    return F.when(n == 0, 1.0).otherwise(_discounted(F.filter(ranks, lambda r: r <= k)) / ideal)


def citation_accuracy(answer: Column | str, n_sources: Column | str) -> Column:
    """has_citations, total_citations, valid_citations, invalid_citations, citation_accuracy."""
    found = cited_sources(answer)
    # a number too long for an int names no source
    valid = F.size(F.filter(found, lambda c: (F.try_to_number(F.right(c, F.lit(9)), F.lit("999999999")).cast("int").between(F.lit(1), _col(n_sources))) & (F.length(F.ltrim(c, F.lit("0"))) <= 9)))
    total = F.size(found)
    return F.struct(
        (total > 0).alias("has_citations"), total.alias("total_citations"), valid.alias("valid_citations"), (total - valid).alias("invalid_citations"),
        F.when(total > 0, valid / F.greatest(total, F.lit(1))).otherwise(0.0).alias("citation_accuracy"),
    )


def faithfulness(answer: Column | str, context: Column | str) -> Column:
    """The share of the answer's content words that the context has."""
    said = F.filter(plain_words(answer), lambda w: ~w.isin(FUNCTION_WORDS))
    given = F.array_distinct(plain_words(context))
    supported = let(given, lambda g: F.size(F.filter(said, lambda w: F.array_contains(g, w))))
    blank = (stripped(answer) == "") | (stripped(context) == "")
    return F.when(blank, 0.0).when(F.size(said) == 0, 1.0).otherwise(supported / F.greatest(F.size(said), F.lit(1)))
