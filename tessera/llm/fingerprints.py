"""Document fingerprints by I-Match.

A text's terms are its distinct words. Of these the ones count that lie in a band of inverse document
frequency: in at least LEAST_DF documents, in at least the share LEAST_SHARE of all and in at most the share
MOST_SHARE. All banded terms of a text are sorted and hashed under randomised lexicons: the whole band, and
FAMILIES families of LEVELS nested lexicons, which keep a half of the band, a quarter, an eighth and
so on, each family by another random hash of the terms. The fingerprint has a hash for each lexicon that holds a
term of the text.

Likeness is the largest share, over the levels, of families whose hashes at that level are equal; it is 1 if the hashes
under the whole band are. A near copy agrees in lexicons that keep much of the band, a text of which
half is other text only in such that keep a few of its terms.

Equal texts have equal fingerprints. Null and empty texts, and texts without a term in the band, have no hashes; they are
alike (1) only to others without. Words are runs of letters and digits, lower-cased. Rows that repeat stay; of
rows with one doc_id the order is that of their texts, rows without a doc_id come last. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runs import let
from tessera.llm.tables import joined_side, ranked, written

FAMILIES = 8
LEVELS = 12
LEAST_DF = 2
LEAST_SHARE = 0.0005
MOST_SHARE = 0.1
#: Documents whose ids agree but for so many bits are neighbours in one task.
BUCKET_BITS = 11


def terms(text: Column | str) -> Column:
    """Hashes of the distinct words."""
    words = F.split(F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(F.array_distinct(words), ""), lambda w: F.xxhash64(w))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(h, df): in how many rows each term is."""
    return docs.select(F.explode(terms("text")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))


def band(docs: DataFrame, least_df: int = LEAST_DF, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """(h, banded): the terms in the band.

    As each is in the share ``least_share`` of the documents, there are at most 1 / least_share times as many as
    a document has terms on average, however many documents there are: with 500 terms a document a million, of 8 bytes each.
    """
    n = docs.count()
    kept = document_frequency(docs).where((F.col("df") >= max(least_df, least_share * n)) & (F.col("df") <= max(most_share * n, 5.0)))
    return written(kept.select("h", F.lit(True).alias("banded")), "band")


def print_of(banded: Column) -> Column:
    """The fingerprint of sorted terms: ``whole``, and in ``ladder`` for each family its hashes, level by level, up to the last that holds a term."""

    def short(terms_: Column) -> Column:
        return F.shiftright(F.xxhash64(terms_), 32).cast("int")

    def family(own: Column, k: Column) -> Column:
        start = F.struct(own.alias("own"), F.array().cast("array<int>").alias("out"))

        def deeper(state: Column, level: Column) -> Column:
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
            kept = F.filter(state["own"], lambda h: F.xxhash64(h, k).bitwiseAND(mask) == 0)
            return let(kept, lambda own_: F.struct(own_.alias("own"), F.when(F.size(own_) > 0, F.concat(state["out"], F.array(short(own_)))).otherwise(state["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, deeper)["out"]

    ladder = lambda own: F.transform(F.sequence(F.lit(0), F.lit(FAMILIES - 1)), lambda k: family(own, k))
    return let(F.sort_array(banded), lambda own: F.struct(F.when(F.size(own) > 0, short(own)).alias("whole"), ladder(own).alias("ladder")))


def as_text(print_: Column) -> Column:
    """The whole band's hash and each family's hashes, in hexadecimal."""
    text = lambda h: F.lower(F.lpad(F.right(F.hex(h.cast("long")), F.lit(8)), 8, "0"))
    families = F.transform(print_["ladder"], lambda hashes: F.array_join(F.transform(hashes, text), "."))
    return F.concat(F.coalesce(text(print_["whole"]), F.lit("-")), F.lit("/"), F.array_join(families, "/"))


def likeness(x: Column, y: Column) -> Column:
    """0 to 1, of two fingerprints."""

    def share(level: Column) -> Column:
        at = F.zip_with(x["ladder"], y["ladder"], lambda a, b: F.coalesce(F.get(a, level) == F.get(b, level), F.lit(False)))
        return F.size(F.filter(at, lambda same: same)) / FAMILIES

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), share))
    return F.when(x["whole"].eqNullSafe(y["whole"]), 1.0).otherwise(best)


def prints(rows: DataFrame, key: list[str], kinds: list[str], band_: DataFrame) -> DataFrame:
    """``rows`` with, for each of one or two ``kinds``, the fingerprint struct in place of the column of terms.

    The band has a bounded number of terms for each term that a document has on average (see `band`). Up to MOST_BROADCAST of them, which are counted,
    go to all executors: terms that are not in it leave the rows where they are, and rows that are dealt out by (some of) the
    ``key`` stay there. A larger one, of book-length documents, is met by a shuffle of the terms, in which Spark splits frequent ones.
    """
    other = [c for c in rows.columns if c not in key and c not in kinds]

    def marked(bits: int, terms_: Column) -> Column:
        return F.transform(terms_, lambda h: F.struct(F.lit(bits).cast("byte").alias("bits"), h.alias("h")))

    # a term of both kinds goes once, with both bits
    own, *new = (F.col(k) for k in kinds)
    marks = [marked(1, F.array_except(own, new[0])), marked(2, F.array_except(new[0], own)), marked(3, F.array_intersect(own, new[0]))] if new else [marked(1, own)]
    each = rows.select(*key, F.struct(*other, F.lit(0).alias("_")).alias("other"), F.posexplode_outer(F.flatten(F.array(*marks))).alias("i", "x"))
    # one row of each key carries the other columns
    each = each.select(*key, F.when(F.coalesce("i", F.lit(0)) == 0, F.col("other")).alias("other"), "x.bits", "x.h")
    each = each.join(joined_side(band_, band_.count()), "h", "left").where("banded or other is not null")
    own = [F.collect_list(F.when(F.col("banded") & (F.col("bits").bitwiseAND(F.lit(1 << i).cast("byte")) != 0), F.col("h"))).alias(k) for i, k in enumerate(kinds)]
    each = each.groupBy(*key).agg(F.first("other", ignorenulls=True).alias("other"), *own)
    return each.select(*key, *(F.col("other")[c].alias(c) for c in other), *(print_of(F.col(k)).alias(k) for k in kinds))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, at, doc_id, text, next_bucket, next_text): every document with the next one by descending doc_id.

    After the last comes the first. Ids are dealt out in buckets, and sorted there; the seams between
    buckets are a row for each bucket.
    """
    # rows without an id come last, dealt by their texts
    bucket = F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.lit(-(1 << 62)) + F.pmod(F.xxhash64("text"), F.lit(1 << 16)))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc(), F.col("text").desc())
    rows = docs.select(bucket.alias("bucket"), "doc_id", "text")
    rows = rows.select("*", F.row_number().over(w).alias("at"), F.lead(F.struct("text")).over(w).alias("ahead"))
    heads = rows.where("at = 1").select("bucket", F.col("text").alias("head"))
    chain = ranked(docs.select(bucket.alias("bucket")).distinct(), [F.col("bucket").desc()], "k")
    chain = written(chain, "chain")
    n = chain.count()
    after = chain.select(F.pmod(F.col("k") - 1, F.lit(max(n, 1))).alias("k"), F.col("bucket").alias("next_bucket"))
    seams = chain.join(after, "k").join(heads.withColumnRenamed("bucket", "next_bucket"), "next_bucket").select("bucket", "next_bucket", "head")
    out = rows.join(seams, "bucket")
    inside = F.col("ahead").isNotNull()
    return out.select(
        "bucket", "at", "doc_id", "text", F.when(inside, F.col("bucket")).otherwise(F.col("next_bucket")).alias("next_bucket"),
        F.when(inside, F.col("ahead.text")).otherwise(F.col("head")).alias("next_text"),
    )


def edited(text: Column, other: Column) -> Column:
    """The text, its last floor(n/2) code points replaced by the first as many (or all) of another."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, least_df: int = LEAST_DF, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs`` (doc_id, text); equal texts get equal ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "text")
    texts = keyed.dropDuplicates(["h1", "h2"]).select("h1", "h2", terms("text").alias("own"))
    made = prints(texts, ["h1", "h2"], ["own"], band(rows, least_df, least_share, most_share))
    return keyed.select("doc_id", "h1", "h2").join(made, ["h1", "h2"]).select("doc_id", as_text(F.col("own")).alias("fingerprint"))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: every document against its
    edited text and the next document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    pairs = with_next(rows).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.select("bucket", "at", "doc_id", "next_bucket", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), terms("text").alias("own"), terms("edited").alias("new"))
    made = prints(pairs, ["bucket", "at"], ["own", "new"], band(rows))
    ahead = F.lead("own").over(Window.partitionBy("bucket").orderBy("at"))
    made = made.withColumn("next", ahead).withColumn("near_next", F.when(F.col("next").isNotNull(), likeness(F.col("own"), F.col("next"))))
    made = written(made.drop("next"), "prints")
    # the last of a bucket goes with the first of the next one
    heads = made.where("at = 1").select(F.col("bucket").alias("next_bucket"), F.col("own").alias("head"))
    seams = made.where("near_next is null").join(heads, "next_bucket").withColumn("near_next", likeness(F.col("own"), F.col("head"))).drop("head")
    out = made.where("near_next is not null").unionByName(seams)
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), "near_next",
    )
