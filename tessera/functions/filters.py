"""Metadata filters: a conjunction of equalities, compiled to a column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(key: str) -> Callable[[str], Column]:
    """The field of this name in ``metadata``, as some type. Paths can't say all names; the others are looked up in a map."""
    if key and not set(key) & set("'?"):
        return lambda kind: F.try_variant_get("metadata", f"$['{key}']", kind)
    return lambda kind: F.try_variant_get(F.try_variant_get("metadata", "$", "map<string,variant>")[key], "$", kind)


def matches(df: DataFrame, filters: Mapping[str, Any] | None) -> Column:
    """Whether a row has all these values; a missing value equals None, and text never equals a number.

    Keys are columns of ``df``, or fields of its VARIANT column ``metadata``.
    """
    tests = []
    for key, value in (filters or {}).items():
        if key in df.columns:
            number, text = not isinstance(value, str), df.schema[key].dataType.typeName() == "string"
            tests.append(F.lit(False) if value is not None and number == text else F.col(key).eqNullSafe(F.lit(value)))
        elif "metadata" in df.columns:
            get = _field(key)
            kind = F.schema_of_variant(get("variant"))
            if isinstance(value, str):
                tests.append(F.coalesce((get("string") == value) & (kind == "STRING"), F.lit(False)))
            elif value is None:
                tests.append(get("variant").isNull() | F.is_variant_null(get("variant")))
            else:
                number = F.when(kind == "BOOLEAN", get("boolean").cast("double")).otherwise(get("double"))
                tests.append(F.coalesce((number == float(value)) & (kind != "STRING"), F.lit(False)))
        else:
            tests.append(F.lit(value is None))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
