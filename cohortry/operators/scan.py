"""Distributed running aggregates and ranks.

A running total over a whole table must not become one unpartitioned window. Here the rows are range-partitioned on group and order;
each (group, partition) is scanned on its own and receives the totals of the partitions before it. The engine draws the bounds from the
frame that is scanned, and their number follows its size, so a task is bounded by a partition, also when one group holds most rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import checkpoint

_FN = {"sum": F.sum, "max": F.max, "min": F.min}
_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def join_same_keys(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join on equal names where null keys match null keys; the right key copies are dropped."""
    if not on:
        raise ValueError("join_same_keys needs at least one key")
    keys = {c: f"__r_{c}" for c in on}
    right = right.withColumnsRenamed(keys)
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(r)) for c, r in keys.items()])
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*keys.values())


def prefix_scan(
    df: DataFrame,
    by: list[str],
    order: str,
    scans: dict[str, tuple[str, str]],
    descending: bool = False,
    cells: int | None = None,
) -> DataFrame:
    """Add inclusive running ``sum``/``max``/``min`` columns along ``order`` within ``by``.

    ``scans`` maps an output name to ``(fn, column)``. ``order`` must be unique within ``by``; group equal values first.
    The rows are range-partitioned on (by, order); a cell is one of these partitions (``cells`` of them, else as many as the
    session and adaptive execution choose for the size). They are checkpointed, so every later step sees the same cells.
    """
    for fn, _ in scans.values():
        if fn not in _FN:
            raise ValueError(f"unsupported running aggregate: {fn}")
    ranged = df.repartitionByRange(*([cells] if cells else []), *[F.col(c).asc_nulls_first() for c in [*by, order]])
    placed = checkpoint(ranged.withColumn("__cell", F.spark_partition_id()))
    keys = [*by, "__cell"]
    sort = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    inside = Window.partitionBy(*keys).orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    scanned = placed.select("*", *[_FN[fn](c).over(inside).alias(name) for name, (fn, c) in scans.items()])

    # At most one row per (group, cell); the carry of a cell is the total of the cells before it.
    totals = placed.groupBy(*keys).agg(*[_FN[fn](c).alias(f"__t_{name}") for name, (fn, c) in scans.items()])
    before = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(F.col("__cell").desc() if descending else F.col("__cell").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys, *[_FN[fn](f"__t_{name}").over(before).alias(f"__c_{name}") for name, (fn, _) in scans.items()]
    )
    out = join_same_keys(scanned, carry, keys, "left")
    return out.select(
        *df.columns,
        *[_MERGE[fn](F.col(name), F.col(f"__c_{name}")).alias(name) for name, (fn, _) in scans.items()],
    )


def numbered_rows(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``row_number`` from 1 along a unique ``order`` within ``by``, without one task per group."""
    counted = df.withColumn("__one", F.lit(1).cast("long"))
    return prefix_scan(counted, by, order, {name: ("sum", "__one")}).drop("__one")


def rank_rows(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` from 1 within ``by`` along several columns that together are unique; nulls first.

    Each column in turn adds the count of rows below within the columns before it, so neither a tie nor a group
    has to fit one task.
    """
    out = df
    for i, c in enumerate(order):
        keys = [*by, *order[:i]]
        per = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
        below = prefix_scan(per, keys, c, {"__end": ("sum", "__n")})
        out = join_same_keys(out, below.select(*keys, c, (F.col("__end") - F.col("__n")).alias(f"__below_{i}")), [*keys, c])
    rank = reduce(lambda a, b: a + b, [F.col(f"__below_{i}") for i in range(len(order))]) + 1
    return out.select(*df.columns, rank.alias(name))
