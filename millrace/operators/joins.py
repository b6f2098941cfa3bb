"""Equi joins in which NULL equals NULL.

No side is broadcast by hand: Spark broadcasts a side whose size it knows to be small, and
adaptive execution splits the partitions of a hot key otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str
) -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; key columns come from the left side."""
    renamed = right.withColumnsRenamed({key: f"__right_{i}" for i, key in enumerate(keys)})
    matches = [
        left[quoted(key)].eqNullSafe(renamed[f"__right_{i}"]) for i, key in enumerate(keys)
    ]
    joined = left.join(renamed, reduce(lambda a, b: a & b, matches), how)
    return joined.drop(*[f"__right_{i}" for i in range(len(keys))])


def anti_join_null_safe(
    candidates: DataFrame, existing: DataFrame, on: Sequence[str]
) -> DataFrame:
    """The candidates whose key is not among the existing rows."""
    return null_safe_join(candidates, existing.select(*map(quoted, on)), on, "left_anti")


def inner_join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``left`` with the columns ``right`` has for their key."""
    return null_safe_join(left, right, on, "inner")


def one_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for every key, ready to be the small side of a join on that key.

    Grouping by a struct of the key keeps the join from reusing this shuffle. With a shuffle
    of its own on both sides the join can split the partition of a hot key; joined straight
    to an aggregation it could not. The second shuffle moves one row per key only.
    """
    rest = [name for name in df.columns if name not in keys]
    rows = df.groupBy(F.struct(*map(quoted, keys)).alias("__key"))
    if not rest:
        return rows.agg(F.lit(1).alias("__one")).select("__key.*")
    firsts = [F.first(quoted(name)).alias(name) for name in rest]
    return rows.agg(*firsts).select("__key.*", *map(quoted, rest))
