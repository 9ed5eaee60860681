"""Sorting, top-k, seeded order and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.aggregate import dedupe


def _sort_keys(order):
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def sort(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, ascending) pairs."""
    return df.orderBy(*_sort_keys(order))


def top_per_group(df: DataFrame, by: list[str], order: list[tuple[str, bool]], k: int = 1) -> DataFrame:
    """First k rows per group. The rank filter limits each group before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*_sort_keys(order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def pick_priority(df: DataFrame, by: list[str], value: str, priority: str) -> DataFrame:
    """The value with the smallest priority per group (ties: smallest value)."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(priority, value)).alias(value))


def earliest(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Earliest record per key; ties by the remaining columns."""
    return dedupe(df.where(F.col(ts).isNotNull()), by, ts)


def top_k(df: DataFrame, order: list[tuple[str, bool]], k: int) -> DataFrame:
    return df.orderBy(*_sort_keys(order)).limit(k)


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Seeded order that depends on the key only, not on partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def union_distinct(*dfs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union without duplicate rows, or one row per key."""
    out = union_all(*dfs)
    return out.distinct() if keys is None else dedupe(out, keys)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys are not in ``b``."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys are in ``b``."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def key_spine(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct key combinations over all frames."""
    return reduce(DataFrame.union, [d.select(*keys) for d in dfs]).distinct()
