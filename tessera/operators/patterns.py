"""Which of many patterns each of many texts contains: one pass over the texts with an automaton of all patterns, not a join of all pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.shared import written

#: Letters of the patterns that go to the tasks at once; more take several passes over the texts.
BLOCK_BYTES = 4 << 20


def _automaton(patterns: Sequence[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    made.make_automaton()
    return made


def contained(texts: DataFrame, keys: Sequence[str], text: str, patterns: DataFrame) -> DataFrame:
    """(*keys, pattern): every row of ``texts`` with each of ``patterns`` (pattern) that ``text`` contains, letter by letter, once a row.

    Null texts and patterns match nothing; the empty pattern is in every text. Patterns go to the tasks in blocks, by the checked size of all; of
    several blocks each pass is written before the next one's patterns are fetched.
    """
    rows = patterns.select("pattern").where("pattern is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("pattern") + 1), F.lit(0))).first()[0]
    blocks = int(size // BLOCK_BYTES) + 1
    scanned = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    schema = StructType([scanned.schema[k] for k in keys]).add("pattern", "string")

    def one(block: int) -> DataFrame:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        sent = scanned.sparkSession.sparkContext.broadcast(sorted(r.pattern for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = [p for p in sent.value if p]
            automaton, empty = _automaton(given) if given else None, len(given) < len(sent.value)
            for batch in batches:
                place, said = [], []
                for i, t in enumerate(batch.column("_text").to_pylist()):
                    has = {p for _, p in automaton.iter(t)} if automaton is not None and t else set()
                    said += [*sorted(has), *([""] if empty else [])]
                    place += [i] * (len(said) - len(place))
                at = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(said, pa.string())], names=[*keys, "pattern"])

        out = scanned.mapInArrow(run, schema)
        return out if blocks == 1 else written(out)

    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
