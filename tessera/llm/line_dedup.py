"""Line dedup by a suffix array over line ids, made by distributed prefix doubling.

A line's id is a 128-bit hash of the line. Suffixes (of a document's sequence of line
ids) are named by the order of their first h lines, for h = 1, 2, 4, ...: the name of
2h lines is the place, in the sorted distinct pairs, of the names of the first and the
second h. Only suffixes whose first h lines occur more than once go on to the next
round; the others have their place in the array. The suffixes with one name are
a longest-common-prefix interval: they share h lines at least. In each interval of
at least ``min_lines`` lines all but the first copy, by (doc_id, line), are later
copies; the lines that they cover are deleted. As every sub-run of a repeated run is
repeated, that deletes the maximal repeated runs whole. With ``long_words`` later copies of single lines
of at least so many words go too.

Hot lines do no harm: names, and first copies, come from sums by key, which are summed before they are
shuffled; names go back over a join with one row a key on the other side, which can be split; first
copies are told from later ones by their place, not by their name. Every join shuffles, at every size.

Lines are what stands between newlines; blank ones count, though a run of blank lines
alone is kept. Null texts stay null and have no lines; an empty text has one blank line.
Rows that repeat a doc_id are told apart by their texts; rows equal in both
are one document and get the same text. A row without a doc_id keeps its text. Ties among copies go by (doc_id, the
text's hash, line). Other columns pass through `deduplicated`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runs import covered, merged, outside
from tessera.llm.tables import dropped, free, ranked, written

MIN_LINES = 2
#: Words of a line that is a passage by itself.
LONG_WORDS = 25
WHERE = ["doc_id", "copy", "i"]


def lines_of(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """(doc_id, copy, i, n, id, blank, and long with ``long_words``): every line's place and id; `copy` tells rows of one doc_id apart."""
    rows = docs.where("text is not null").select("doc_id", "copy", F.split("text", "\n").alias("lines"))
    rows = rows.select("doc_id", "copy", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    # two hashes with unlike seeds, 128 bits together
    long = [] if long_words is None else [(F.size(F.split(F.trim("line"), r"\s+")) >= long_words).alias("long")]
    return rows.select(*WHERE, "n", F.xxhash64("line").alias("id1"), F.xxhash64(F.lit(1), "line").alias("id2"), (F.trim("line") == "").alias("blank"), *long)


def _named(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """The rows whose key occurs more than once, with ``name``: the key's place in the order of keys."""
    keys = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(ranked(keys, [F.col(k) for k in key], name).select(*key, name), key)


def suffix_names(lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """(h, table) for h = 1, 2, 4, ...: the suffixes whose first h lines (all within the document) recur, with their `name`."""
    long = [c for c in lines.columns if c == "long"]
    first = _named(lines.select(*WHERE, "n", "blank", *long, "id1", "id2"), ["id1", "id2"], "name")
    levels = [(1, written(first.select(*WHERE, "n", "blank", *long, "name").distinct(), "names"))]
    while True:
        h, now = levels[-1]
        ahead = now.select("doc_id", "copy", (F.col("i") - h).alias("i"), F.col("name").alias("next"), F.col("blank").alias("next_blank"))
        pairs = now.where(F.col("i") + 2 * h <= F.col("n")).join(ahead, WHERE)
        pairs = pairs.select(*WHERE, "n", F.col("name").alias("own"), "next", (F.col("blank") & F.col("next_blank")).alias("blank"))
        pairs = written(pairs, "pairs")
        named = _named(pairs, ["own", "next"], "name")
        named = written(named.select(*WHERE, "n", "blank", "name"), "names")
        dropped(pairs)
        if named.isEmpty():
            return levels
        levels.append((2 * h, named))


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, copy, i, h): suffixes whose first h lines have a copy before them, for h from min_lines on, and for h = 1 where the line is long."""
    levels = suffix_names(lines)
    base = 1 << (min_lines.bit_length() - 1)  # the largest power of two that is no larger
    out = []
    for h, names in levels:
        if h < base:
            if h > 1 or "long" not in names.columns:
                continue
            names, key, length = names.where("long"), ["name"], 1
        elif h == base != min_lines:
            # min_lines is no power of two: two overlapping runs of `base` lines name it
            ahead = names.select("doc_id", "copy", (F.col("i") - (min_lines - base)).alias("i"), F.col("name").alias("next"), F.col("blank").alias("next_blank"))
            names = names.join(ahead, WHERE).withColumn("blank", F.col("blank") & F.col("next_blank"))
            key, length = ["name", "next"], min_lines
        else:
            key, length = ["name"], h
        if length < min_lines and h >= base:
            continue
        names = names.where("not blank")
        first = names.groupBy(*key).agg(F.min(F.struct(*WHERE)).alias("first")).select("first.*")
        # first copies go by their place: a name may be that of very many lines
        out.append(names.join(first, WHERE, "left_anti").select(*WHERE, F.lit(length).alias("h")))
    if not out:
        return lines.select(*WHERE, F.lit(0).alias("h")).limit(0)
    return reduce(DataFrame.unionByName, out)


def removals(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, copy, runs, longest_run): the runs [from, until) of lines to delete, merged and in order."""
    spans = later_copies(lines, min_lines).groupBy(*WHERE).agg(F.max("h").alias("h"))
    spans = spans.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("from"), (F.col("i") + F.col("h")).alias("until")))).alias("spans"))
    runs = spans.select("doc_id", "copy", merged("spans").alias("runs"))
    return runs.withColumn("longest_run", F.array_max(F.transform("runs", lambda r: r["until"] - r["from"])))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs (and of lines of ``long_words`` and more) deleted from `text`, and n_lines, n_removed, longest_run added (or replaced)."""
    text, sha = F.col("text").cast("string"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0).cast("long"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sha.alias("copy"))
    gone = removals(lines_of(keyed.where("doc_id is not null"), long_words), min_lines)
    rows = docs.drop("n_lines", "n_removed", "longest_run")
    id_, copy, runs, longest, lines = free(rows, "id", "copy", "runs", "longest", "lines")
    gone = gone.select(F.col("doc_id").alias(id_), F.col("copy").alias(copy), F.col("runs").alias(runs), F.col("longest_run").alias(longest))
    out = rows.join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (sha == F.col(copy)), "left").withColumn(lines, F.split(text, "\n"))
    out = out.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(outside(lines, runs), "\n")))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", covered(runs)).withColumn("longest_run", F.coalesce(longest, F.lit(0)).cast("long"))
    return out.drop(id_, copy, runs, longest, lines)
