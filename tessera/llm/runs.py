"""Runs [from, until) of an array's elements: merging them, and what lies outside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and wherever it is used."""
    return F.transform(F.array(value), use)[0]


def merged(runs: Column | str) -> Column:
    """The runs in order; such that touch or overlap become one."""
    runs = F.array_sort(runs)

    def add(done: Column, x: Column) -> Column:
        tail = F.try_element_at(done, F.lit(-1))
        longer = F.struct(tail["from"].alias("from"), F.greatest(tail["until"], x["until"]).alias("until"))
        joins = (F.size(done) > 0) & (x["from"] <= tail["until"])
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(runs, F.slice(runs, 1, 0), add)


def covered(runs: Column | str) -> Column:
    """How many elements merged runs have."""
    return F.coalesce(F.aggregate(runs, F.lit(0), lambda n, r: n + (r["until"] - r["from"]).cast("int")), F.lit(0)).cast("long")


def outside(elements: Column | str, runs: Column | str) -> Column:
    """``elements`` without merged runs."""
    elements, runs = (F.col(x) if isinstance(x, str) else x for x in (elements, runs))
    return let(elements, lambda e: let(runs, lambda r: _outside(e, r)))


def _outside(elements: Column, runs: Column) -> Column:
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(runs)),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(runs, F.greatest(k, F.lit(1)))["until"]).alias("from"),
            F.when(k == F.size(runs), F.size(elements)).otherwise(F.try_element_at(runs, k + 1)["from"]).alias("until"),
        ),
    )
    return F.flatten(F.transform(gaps, lambda r: F.slice(elements, (r["from"] + 1).cast("int"), (r["until"] - r["from"]).cast("int"))))
