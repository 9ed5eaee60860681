"""Equi, range, spine and membership joins.

No side is hinted for broadcast: Spark's size-checked auto broadcast and AQE choose, and AQE splits hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.scan import join_same_keys

WIDE = 64
HOW = ("inner", "left", "right", "left_semi", "left_anti")


def join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", where=None) -> DataFrame:
    """Join on equal key names plus an optional condition over ``a.…``/``b.…`` columns (SQL text or Column).

    The key columns appear once; other columns must differ in name, as in ``DataFrame.join(on=[…])``.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    left, right = a.alias("a"), b.alias("b")
    if where is None:
        return left.join(right, on, how)
    extra = F.expr(where) if isinstance(where, str) else where
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], extra)
    out = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    kept = "b" if how == "right" else "a"
    keys = [F.col(f"{kept}.{k}") for k in on]
    return out.select(
        *keys, *[F.col(f"a.{c}") for c in a.columns if c not in on], *[F.col(f"b.{c}") for c in b.columns if c not in on]
    )


def _position(col: str, kind: str):
    """Column on a numeric axis: days for dates and timestamps, the value itself for numbers."""
    if kind == "date" or kind.startswith("timestamp"):
        return F.unix_date(F.to_date(F.col(col)))
    return F.col(col)


def range_join(
    points: DataFrame, intervals: DataFrame, on: list[str], t: str, lo: str, hi: str, bucket: int = 50, how: str = "inner",
    long_spans: bool = False, ask: bool = False,
) -> DataFrame:
    """Join points to intervals with ``lo <= t <= hi`` and equal keys.

    The axis is cut into cells of ``bucket`` days (or units). An interval is copied into the cells it covers, a point
    lies in exactly one, so the join is an equi join on (keys, cell), hot keys spread over their cells, and a pair
    meets once. ``how`` may be inner, left_semi or left_anti over the points.

    With ``long_spans`` intervals of more than 64 cells (open ends, sentinel dates) use cells 64 times as wide, and each point is
    offered on both grids. An inner or semi join then costs twice the points instead of thousands of copies of an interval. With ``ask``
    an inner join looks up first which of the two grids the intervals use, and a point is offered on those only; that reads the
    intervals once more, so it is for intervals that are cheap to compute.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left_semi or left_anti")
    clash = [c for c in points.columns if c in intervals.columns and c not in on]
    if how == "inner" and clash:
        raise ValueError(f"columns on both sides besides the keys: {clash}")
    kinds_p, kinds_i = dict(points.dtypes), dict(intervals.dtypes)
    at, start, stop = _position(t, kinds_p[t]), _position(lo, kinds_i[lo]), _position(hi, kinds_i[hi])
    names = {c: f"__i_{c}" for c in intervals.columns}
    valid = intervals.where(F.col(lo) <= F.col(hi))
    if long_spans and how == "left_anti":
        # A point must miss the intervals of both grids.
        wide = (stop - start) / bucket > WIDE
        rest = range_join(points, valid.where(~wide), on, t, lo, hi, bucket, how)
        return range_join(rest, valid.where(wide), on, t, lo, hi, bucket * WIDE, how)
    if long_spans and how == "left_semi":
        wide = (stop - start) / bucket > WIDE
        hit = range_join(points, valid.where(~wide), on, t, lo, hi, bucket, how)
        rest = range_join(points, valid.where(~wide), on, t, lo, hi, bucket, "left_anti")
        return hit.union(range_join(rest, valid.where(wide), on, t, lo, hi, bucket * WIDE, how))
    if long_spans:
        width = F.when((stop - start) / bucket > WIDE, bucket * WIDE).otherwise(bucket)
        both = F.array(F.lit(bucket), F.lit(bucket * WIDE))
        used = valid.agg(F.collect_set(width)).scalar() if ask else both
        p = points.withColumn("__width", F.explode(F.array_intersect(both, used)))
        i = valid.withColumn("__iwidth", width)
        p, i = p.withColumn("__cell", F.floor(at / F.col("__width"))), i.withColumn("__icell", F.explode(F.sequence(F.floor(start / F.col("__iwidth")), F.floor(stop / F.col("__iwidth")))))
    else:
        p = points.withColumns({"__width": F.lit(0), "__cell": F.floor(at / bucket)})
        i = valid.withColumns({"__iwidth": F.lit(0), "__icell": F.explode(F.sequence(F.floor(start / bucket), F.floor(stop / bucket)))})
    i = i.withColumnsRenamed(names)
    same_cell = F.col("__cell") == F.col("__icell")
    if long_spans:
        same_cell = same_cell & (F.col("__width") == F.col("__iwidth"))
    cond = reduce(
        lambda x, y: x & y, [F.col(k) == F.col(f"__i_{k}") for k in on],
        same_cell & (F.col(t) >= F.col(f"__i_{lo}")) & (F.col(t) <= F.col(f"__i_{hi}")),
    )
    if how == "inner":
        out = p.join(i, cond, "inner").drop("__cell", "__icell", "__width", "__iwidth", *[f"__i_{k}" for k in on])
        return out.withColumnsRenamed({v: k for k, v in names.items() if k not in on})
    return p.join(i, cond, how).drop("__cell", "__width")


def meeting_spans(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[Column, Column], b_span: tuple[Column, Column], bucket: int) -> DataFrame:
    """Pairs of rows with equal keys whose spans of days (first, last) meet, each once, by one join on (keys, cell).

    Both sides are copied into the cells that they cover; a pair is taken in the cell of the later start. Pairs with a span of more
    than 64 cells use cells 64 times as wide: every row of ``a`` is offered there, rows of ``b`` only if ``a`` has such spans or they are
    such themselves. That is looked up, so ``a`` should be cheap to compute.
    """
    clash = [c for c in a.columns if c in b.columns and c not in on]
    if clash:
        raise ValueError(f"columns on both sides besides the keys: {clash}")
    (a0, a1), (b0, b1) = [tuple(F.unix_date(c) for c in span) for span in (a_span, b_span)]

    def cells(first, last, width: int):
        return F.transform(F.sequence(F.floor(first / width), F.floor(last / width)), lambda c: F.struct(F.lit(width).alias("width"), c.alias("cell")))

    def offered(df: DataFrame, first, last, always, name: str) -> DataFrame:
        wide = (last - first) / bucket > WIDE
        none = F.array().cast("array<struct<width:int,cell:bigint>>")
        own = F.concat(F.when(wide, none).otherwise(cells(first, last, bucket)), F.when(wide | always, cells(first, last, bucket * WIDE)).otherwise(none))
        return df.where(first <= last).withColumns({f"{name}_wide": wide, name: F.explode(own)})

    any_wide = F.coalesce(a.where(a0 <= a1).agg(F.max((a1 - a0) / bucket > WIDE)).scalar(), F.lit(False))
    names = {k: f"__i_{k}" for k in on}
    left = offered(a, a0, a1, F.lit(True), "__a").withColumns({"__width": F.col("__a.width"), "__cell": F.col("__a.cell")}).drop("__a")
    right = offered(b, b0, b1, any_wide, "__b").withColumns({"__iwidth": F.col("__b.width"), "__icell": F.col("__b.cell")}).drop("__b").withColumnsRenamed(names)
    meet = (a0 <= b1) & (b0 <= a1) & (F.col("__cell") == F.floor(F.greatest(a0, b0) / F.col("__width")))
    same_grid = (F.col("__width") == bucket) | F.col("__a_wide") | F.col("__b_wide")
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(r) for k, r in names.items()], (F.col("__width") == F.col("__iwidth")) & (F.col("__cell") == F.col("__icell")))
    return left.join(right, same & same_grid & meet).drop("__width", "__iwidth", "__cell", "__icell", "__a_wide", "__b_wide", *names.values())


def link_children(df: DataFrame, child_key: str, parent_key: str, keep: list[str], prefix: str = "parent_") -> DataFrame:
    """Self join of child rows to their parent row on ``child.parent_key = parent.child_key``."""
    parent = df.select(F.col(child_key).alias("__pk"), *[F.col(c).alias(f"{prefix}{c}") for c in keep])
    return df.join(parent, F.col(parent_key) == F.col("__pk"), "inner").drop("__pk")


def spine_join(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of all key combinations, left-joined to every table (each unique on the keys)."""
    spine = reduce(DataFrame.union, [t.select(*keys) for t in tables]).distinct()
    return reduce(lambda d, t: join_same_keys(d, t, keys, "left"), tables, spine)


def status_flag(cohort: DataFrame, members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1 for cohort rows whose keys occur in ``members``, else 0, in one pass."""
    hit = members.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return cohort.join(hit, keys, "left").withColumn(name, F.coalesce("__hit", F.lit(0))).drop("__hit")
