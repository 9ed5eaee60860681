"""Calendar buckets, index-relative buckets and aggregation over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.aggregate import _as_list, aggregate, require_columns
from cohortry.operators.scan import join_same_keys, numbered_rows

MAX_BUCKETS = 10_000
UNITS = ("year", "month", "day", "12hour", "6hour", "hour")


def calendar_bucket(ts: Column, unit: str) -> Column:
    """Year as int, else text: YYYY-MM, YYYY-MM-DD, YYYY-MM-DD-NN (NN = part of day or hour)."""
    if unit == "year":
        return F.year(ts)
    if unit == "month":
        return F.date_format(ts, "yyyy-MM")
    if unit == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    hours = {"12hour": 12, "6hour": 6, "hour": 1}.get(unit)
    if hours is None:
        raise ValueError(f"unknown window unit {unit!r}; one of {UNITS}")
    part = F.floor(F.hour(ts) / hours).cast("string")
    return F.when(ts.isNotNull(), F.concat_ws("-", F.date_format(ts, "yyyy-MM-dd"), F.lpad(part, 2, "0")))


def relative_bucket(ts: Column, ref: Column, bounds: list[int]) -> Column:
    """0 before the first bound, i+1 from bound i on, in days from ``ref``; null stays null."""
    days = F.datediff(ts, ref)
    index = F.lit(0)
    for b in sorted(bounds) or [0]:
        index = index + F.when(days >= b, 1).otherwise(0)
    return F.when(days.isNotNull(), index)


def add_window(df: DataFrame, ts: str, name: str, unit: str) -> DataFrame:
    require_columns(df, [ts])
    return df.withColumn(name, calendar_bucket(F.col(ts), unit))


def add_relative_window(df: DataFrame, ts: str, ref: str, bounds: list[int], name: str) -> DataFrame:
    require_columns(df, [ts, ref])
    if any(not isinstance(b, int) for b in bounds):
        raise ValueError("window bounds must be whole days")
    return df.withColumn(name, relative_bucket(F.col(ts), F.col(ref), list(bounds)))


def aggregate_by_window(
    df: DataFrame, by: list[str], win: str, aggs: dict, order_by=None, labels: list[str] | None = None,
    layout: str = "auto", max_cols: int = 100, values: list | None = None,
) -> DataFrame:
    """Aggregate by (keys, bucket), long or widened to one column per measure and bucket.

    Widened columns are ``<col>_<fn>_<bucket label>``. ``values`` names the buckets when they are known; otherwise at most
    ``max_cols + 1`` distinct buckets are looked up to choose the layout. ``labels`` apply to integer buckets only.
    """
    if layout not in ("auto", "wide", "long"):
        raise ValueError("layout must be auto, wide or long")
    integer = dict(df.dtypes)[win] in ("int", "bigint", "smallint", "tinyint")
    if labels is not None and not integer:
        raise ValueError("labels need an integer window column")
    measures = [f"{c}_{fn}" for c, fns in aggs.items() for fn in _as_list(fns)]
    if layout != "long" and values is None:
        room = max_cols // max(len(measures), 1) + 1 if layout == "auto" else MAX_BUCKETS + 1
        values = sorted(r[0] for r in df.select(win).where(F.col(win).isNotNull()).distinct().limit(room).collect())
        if layout == "wide" and len(values) > MAX_BUCKETS:
            raise ValueError(f"more than {MAX_BUCKETS} buckets: use the long layout")
    wide = layout == "wide" or (layout == "auto" and len(values) * len(measures) <= max_cols)

    def label_of(v):
        return labels[v] if labels is not None and 0 <= v < len(labels) else str(v)

    long = aggregate(df, [*by, win], aggs, order_by)
    if wide:
        # `long` has one row per (keys, bucket), so each cell has at most one candidate.
        spread = [
            F.first(F.when(F.col(win) == v, F.col(m)), ignorenulls=True).alias(f"{m}_{label_of(v)}")
            for v in values for m in measures
        ]
        return long.groupBy(*by).agg(*spread)
    if labels is not None:
        pairs = F.create_map(*[x for i, text in enumerate(labels) for x in (F.lit(i), F.lit(text))])
        text = F.coalesce(F.try_element_at(pairs, F.col(win)), F.col(win).cast("string"))
    else:
        text = F.col(win).cast("string")
    return long.select(*by, win, text.alias(f"{win}_label"), *measures)


def aggregate_regular(df: DataFrame, by: list[str], aggs: dict, ts: str, unit: str, name: str = "time_index") -> DataFrame:
    """One row per (keys, calendar bucket), measures ordered by the timestamp."""
    return aggregate(add_window(df, ts, name, unit), [*by, name], aggs, ts)


def aggregate_custom(
    df: DataFrame, by: list[str], aggs: dict, ts: str, ref: str, bounds: list[int],
    labels: list[str] | None = None, layout: str = "auto", max_cols: int = 100, name: str = "time_index",
) -> DataFrame:
    """Aggregate over index-relative buckets; the buckets follow from the bounds, so nothing is looked up."""
    placed = add_relative_window(df, ts, ref, bounds, name)
    values = list(range(len(bounds or [0]) + 1))
    return aggregate_by_window(placed, by, name, aggs, ts, labels, layout, max_cols, values)


def day_offset_pivot(df: DataFrame, by: list[str], ts: str, ref: str, item: str, days: int, prefix: str = "day") -> DataFrame:
    """Distinct items on each day 0..days from the index date, 0 where none."""
    offset = F.datediff(F.col(ts), F.col(ref))
    once = df.select(*by, item, offset.alias("__d")).distinct()
    counts = [
        F.count(F.when((F.col("__d") == d) & F.col(item).isNotNull(), 1)).alias(f"{prefix}_{d}") for d in range(days + 1)
    ]
    return once.groupBy(*by).agg(*counts)


def ledger(df: DataFrame, by: list[str], date: str, label: str) -> DataFrame:
    """First, last and all dated entries per key: first/last date and label, ``entries`` = array<(date, label, labels)>.

    Entries are distinct calendar days, which bounds a key's array by the days observed, however many records the key has.
    ``labels`` holds all distinct labels of the day, ``label`` is the smallest of them.
    """
    daily = df.where(F.col(date).isNotNull()).groupBy(*by, F.to_date(date).alias("date")).agg(
        F.min(label).alias("label"), F.sort_array(F.collect_set(label)).alias("labels")
    )
    entry = F.struct("date", "label", "labels")
    return daily.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        *by,
        F.col("entries")[0]["date"].alias("first_date"),
        F.col("entries")[0]["label"].alias("first_label"),
        F.element_at("entries", -1)["date"].alias("last_date"),
        F.element_at("entries", -1)["label"].alias("last_label"),
        "entries",
    )


def group_max(df: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
    """The group's maximum on every row: a map-side combined aggregate joined back."""
    return join_same_keys(df, df.groupBy(*by).agg(F.max(col).alias(name)), by, "left")


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Last record per key; ties by the remaining columns."""
    rest = [c for c in df.columns if c not in by]
    rank = F.struct(order, *[c for c in rest if c != order])
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("__row")).select(*by, "__row.*").select(*df.columns)


def numbered(df: DataFrame, by: list[str], order: str, name: str = "row_id") -> DataFrame:
    """Row number along a unique order column."""
    return numbered_rows(df, by, order, name)
