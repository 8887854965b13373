"""Token counts as rollups that are kept up to date by deltas.

Changes are signed: an insert adds a document and its tokens, a delete takes both away, a
revision adds the difference of the counts. A batch of changes is summed by source,
language and tokenizer version before anything is shuffled, and written as a small table. A log
says which tables count and which batches are in them: each of its entries is the whole state, and the latest one
holds. An entry appears at once or not at all, and never replaces another, so a batch is
committed once, however often it is sent and whoever else commits meanwhile, and a reader sees all of a
batch or nothing. Totals are sums over the tables of the latest entry; `compact` folds these into one
table with an entry of its own, and so does every commit that finds MOST_TABLES of them. An entry names the tables and batches
since then only: the ids of batches that were folded before are rows of tables beside, so that an entry's size does
not grow with the number of batches. What a fold replaced stays until the next one, for readers that are not done.

Null sources, languages and tokenizers are keys of their own. Null counts count as no
tokens. A change with an unknown kind fails. Empty batches can be committed. Rows that
repeat count each. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import written
from tessera.sources.journal import Journal

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def words(text: Column | str = "text") -> Column:
    """Tokenizer version ``words``: runs of what is no white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long")


def marks(text: Column | str = "text") -> Column:
    """Tokenizer version ``marks``: runs of letters and digits, and every other character that is no white space."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r]")).cast("long")


def bpe(path: str, text: Column | str = "text") -> Column:
    """Counts by a tokenizer file of the tokenizers library."""
    import pandas as pd

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)], dtype="int64")

    return count(text)


def counted(docs: DataFrame, counts: dict[str, Column], revised: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, KEY, n_tokens, revised): a row for each document and tokenizer version, as a table of its own."""
    revised = revised or counts
    cells = F.array(*(F.struct(F.lit(k).alias("tokenizer"), c.alias("n_tokens"), revised[k].alias("revised")) for k, c in counts.items()))
    rows = docs.select("doc_id", "source", "lang", F.explode(cells).alias("c"))
    return written(rows.select("doc_id", "source", "lang", "c.*"), "counts")


def new_name() -> str:
    return f"rollup-{uuid.uuid4().hex}"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (KEY, kind, n_tokens, old_tokens) as sums by KEY; old_tokens is needed for revisions, n_tokens for all."""
    kind = F.col("kind")
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - old)
    rows = changes.select(*(F.col(k).cast("string").alias(k) for k in KEY), docs.cast("long").alias("d"), tokens.alias("t"))
    return rows.groupBy(*KEY).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes that turn one set of counts (doc_id, KEY, n_tokens) into another. Whether a row is there decides, not its count: a
    count that was null, or becomes null, is revised."""
    key = ["doc_id", *KEY]
    x, there = F.col, F.lit(True).alias("there")
    b, a = before.select(*key, x("n_tokens").alias("old_tokens"), there).alias("b"), after.select(*key, "n_tokens", there).alias("a")
    same = x("b.doc_id").eqNullSafe(x("a.doc_id"))
    for k in KEY:
        same = same & x(f"b.{k}").eqNullSafe(x(f"a.{k}"))
    kind = F.when(x("b.there").isNull(), "insert").when(x("a.there").isNull(), "delete").otherwise("revise")
    both = b.join(a, same, "full").withColumn("kind", kind)
    cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY]
    n = F.when(x("a.there").isNull(), x("b.old_tokens")).otherwise(x("a.n_tokens"))
    return both.select(*cols, "kind", n.alias("n_tokens"), "b.old_tokens")


#: Tables that a log entry names, at most; the next commit folds them.
MOST_TABLES = 64


@dataclass(frozen=True)
class State:
    """A log entry: its number, the tables that count and the batches that came with them since the last fold, the tables of the ids of
    batches before that, and the tables that the last fold replaced."""

    version: int = 0
    tables: tuple[str, ...] = ()
    batches: tuple[str, ...] = ()
    folded: tuple[str, ...] = ()
    replaced: tuple[str, ...] = ()


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.journal = spark, path, Journal(spark, path)

    def state(self) -> State:
        """The latest log entry."""
        version, said = self.journal.latest()
        return State(version, *(tuple(said[k]) for k in ("tables", "batches", "folded", "replaced"))) if said else State()

    def _advance(self, to: State) -> bool:
        return self.journal.advance(to.version, {"tables": to.tables, "batches": to.batches, "folded": to.folded, "replaced": to.replaced})

    def _written(self, rows: DataFrame, kind: str = "table") -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, state: State) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/{t}" for t in state.tables)) if state.tables else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def _folded(self, state: State) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(*(f"{self.path}/{t}" for t in state.folded)) if state.folded else self.spark.createDataFrame([], "batch string")

    def _has(self, state: State, batch: str) -> bool:
        return batch in state.batches or bool(state.folded) and not self._folded(state).where(F.col("batch") == batch).isEmpty()

    def batches(self) -> list[str]:
        """The ids of the committed batches."""
        now = self.state()
        return sorted([*now.batches, *(r.batch for r in self._folded(now).collect())])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False, and nothing done, if the batch is there already."""
        table = None
        while not self._has(now := self.state(), batch):
            table = table or self._written(signed(changes))
            if self._advance(State(now.version + 1, (*now.tables, table), (*now.batches, batch), now.folded, now.replaced)):
                if len(now.tables) >= MOST_TABLES:
                    self.compact()
                return True
        if table:  # another one was faster
            self.journal.delete(table)
        return False

    def totals(self) -> DataFrame:
        """KEY, n_docs, n_tokens over all committed batches; keys whose documents are all gone are left out."""
        return self._read(self.state())

    def compact(self) -> None:
        """Folds the tables of all committed batches into one, and their ids into one beside it (or, once there are MOST_TABLES of these, all ids into one)."""
        start = self.state()
        table = self._written(self._read(start))
        ids = self.spark.createDataFrame([(b,) for b in start.batches], "batch string")
        whole = len(start.folded) >= MOST_TABLES
        ids = self._written(ids.unionByName(self._folded(start)) if whole else ids, "ids")
        folded = (ids,) if whole else (*start.folded, ids)
        old = (*start.tables, *(start.folded if whole else ()))
        while True:
            now = self.state()
            if not set(start.tables) <= set(now.tables) or now.folded != start.folded:  # folded by another one meanwhile
                self.journal.delete(table)
                self.journal.delete(ids)
                return
            more = tuple(t for t in now.tables if t not in start.tables)
            rest = tuple(b for b in now.batches if b not in start.batches)
            if self._advance(State(now.version + 1, (table, *more), rest, folded, old)):
                for name in now.replaced:
                    self.journal.delete(name)
                return
