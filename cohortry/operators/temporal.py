"""Interval logic between a cohort with index dates and dated facts.

Windows are inclusive calendar-day ranges. Flags, and counts over wide windows, come from running totals at both ends of a window (``asof``).
Where the facts themselves are wanted, they are reduced to one row per key and day (and item) before the join,
and cohort rows to their distinct windows; both are bounded by the calendar for any one key, and the join itself
spreads a key over time cells (``range_join``). A person with a third of all records is therefore no hot spot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.asof import distinct_in_windows, window_flags
from cohortry.operators.joins import meeting_spans, range_join

#: A window of 45 to 120 days is copied into 1.2 to 1.6 cells of this length.
CELL_DAYS = 200


def _windows(cohort: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    return cohort.withColumns({"__lo": F.to_date(lo), "__hi": F.to_date(hi)})


def _in_window(windows: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """Daily facts (with a ``__day``) inside each distinct (keys, __lo, __hi)."""
    spans = windows.select(*keys, "__lo", "__hi").distinct()
    return range_join(daily, spans, keys, "__day", "__lo", "__hi", CELL_DAYS, long_spans=True, ask=True)


def _attach(windows: DataFrame, found: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    out = windows.join(found, [*keys, "__lo", "__hi"], "left").drop("__lo", "__hi")
    return out.na.fill(fill) if fill else out


def flag_in_window(
    cohort: DataFrame, facts: list[DataFrame] | DataFrame, keys: list[str], t: str, lo: Column, hi: Column,
    labels: list[str], prefix: str = "",
) -> DataFrame:
    """1/0 per label: any fact of any source has the label set on a day in [lo, hi]."""
    sources = facts if isinstance(facts, list) else [facts]
    names = {f"__f{i}": prefix + x for i, x in enumerate(labels)}
    flags = [F.max(F.coalesce(F.col(x).cast("int"), F.lit(0))).alias(n) for n, x in zip(names, labels, strict=True)]
    marked = reduce(DataFrame.union, [f.select(*keys, F.to_date(t).alias("__day"), *labels) for f in sources])
    some = reduce(lambda a, b: a | b, [F.coalesce(F.col(x).cast("int"), F.lit(0)) > 0 for x in labels])
    return window_flags(cohort, marked.where(some).groupBy(*keys, "__day").agg(*flags), keys, lo, hi, names)


def active_status(cohort: DataFrame, facts: DataFrame, keys: list[str], index: str, entry: str, days: int, name: str) -> DataFrame:
    """1 if some fact was entered at most ``days`` before the index date (the index lies in entry … entry + days)."""
    marked = facts.select(*keys, entry, F.lit(1).alias(name))
    return flag_in_window(cohort, marked, keys, entry, F.date_sub(F.col(index), days), F.col(index), [name])


def in_windows(cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, windows: list[tuple[Column, Column]]) -> DataFrame:
    """Cohort rows with each fact that lies in all of the given day windows at once."""
    los, his = [F.to_date(a) for a, _ in windows], [F.to_date(b) for _, b in windows]
    both = cohort.withColumns({
        "__lo": F.greatest(*los) if len(los) > 1 else los[0],
        "__hi": F.least(*his) if len(his) > 1 else his[0],
    })
    points = facts.withColumn("__day", F.to_date(t))
    return range_join(points, both, keys, "__day", "__lo", "__hi", CELL_DAYS, long_spans=True, ask=True).drop("__day", "__lo", "__hi")


def unexposed(cohort: DataFrame, exposed: DataFrame, keys: list[str], person_keys: list[str]) -> DataFrame:
    """Cohort rows not exposed themselves and of persons never exposed in any row."""
    rest = cohort.join(exposed.select(*keys).distinct(), keys, "left_anti")
    return rest.join(exposed.select(*person_keys).distinct(), person_keys, "left_anti")


def stays(
    events: DataFrame, by: list[str], kind: str, ts: str, starts: list[str], ends: list[str], recorded: DataFrame | None = None,
) -> DataFrame:
    """Stays (start, end) from a movement stream, merged with recorded stays of the same keys if given."""
    out = events.groupBy(*by).agg(
        F.min(F.when(F.col(kind).isin(starts), F.col(ts))).alias("start"), F.max(F.when(F.col(kind).isin(ends), F.col(ts))).alias("end")
    )
    if recorded is None:
        return out
    both = out.unionByName(recorded.select(*by, "start", "end"))
    return both.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def overlap_or_near(
    cohort: DataFrame, stays: DataFrame, keys: list[str], index: str, start: str, end: str, before: int = 7, after: int = 14,
) -> DataFrame:
    """Stays that contain the index date, or start within (index − before, index + after), with day offsets."""
    i, s, e = F.to_date(index), F.to_date(start), F.to_date(end)
    near = meeting_spans(cohort, stays, keys, (i, i), (F.date_sub(s, after), F.greatest(e, F.date_add(s, before))), CELL_DAYS)
    hit = ((F.col(end) > F.col(index)) & (F.col(index) >= F.col(start))) | ((s > F.date_sub(i, before)) & (s < F.date_add(i, after)))
    return near.where(hit).withColumns(
        {"start_offset": F.datediff(start, index), "end_offset": F.datediff(end, index)}
    )


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], bucket: int = CELL_DAYS) -> DataFrame:
    """Pairs of rows with equal keys whose day spans overlap, each once, by one join. ``a`` is the side that is cheap to compute."""
    days = [F.to_date(c) for c in (*a_span, *b_span)]
    return meeting_spans(a, b, on, (days[0], days[1]), (days[2], days[3]), bucket)


def clipped_days(cohort: DataFrame, stays: DataFrame, keys: list[str], index: str, end: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Per (keys, index, end): inclusive days of stays from the index on that start before ``end``, with first start and last stop."""
    # an index on or after the end counts as a day: the stay must begin before the end and last until the index
    spans = cohort.select(*keys, index, end).distinct().withColumn("__until", F.date_sub(F.to_date(end), 1))
    spans = spans.withColumn("__last", F.greatest(F.to_date(index), "__until"))
    pairs = overlap_join(spans, stays, keys, (index, "__last"), (start, stop)).where(F.to_date(start) <= F.col("__until"))
    begin = F.greatest(F.to_date(start), F.to_date(index))
    return pairs.groupBy(*keys, index, end).agg(
        F.sum(F.datediff(F.to_date(stop), begin) + 1).alias("days"), F.min(begin).alias("first_start"), F.max(F.to_date(stop)).alias("last_stop")
    )


def onset(index: Column, admit: Column, lag: int = 5) -> Column:
    """Treatment onset: the index date if admission was more than ``lag`` days earlier, else the admission."""
    return F.when(admit < F.date_sub(index, lag), index).when(admit >= F.date_sub(index, lag), admit)


def _window_items(cohort, facts, keys, t, lo, hi, item, extra=()):
    """Distinct items per window, with the maximum of each extra 0/1 column."""
    daily = facts.where(F.col(item).isNotNull()).groupBy(*keys, F.to_date(t).alias("__day"), item).agg(*[F.max(c).alias(c) for c in extra] or [F.lit(1).alias("__x")])
    windows = _windows(cohort, keys, lo, hi)
    items = _in_window(windows, daily, keys).groupBy(*keys, "__lo", "__hi", item).agg(*[F.max(c).alias(c) for c in extra] or [F.lit(1).alias("__x")])
    return windows, items


def window_item_counts(
    cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, lo: Column, hi: Column, item: str,
    split: tuple[str, list] | None = None, name: str = "n_items",
) -> DataFrame:
    """Distinct items in [lo, hi] per cohort row; with ``split=(column, values)`` also ``<name>_<value>``; 0 where none."""
    col, values = split or (None, [])
    tags = {f"{name}_{v}": (F.col(col) == v).cast("int") for v in values}
    windows, items = _window_items(cohort, facts.withColumns(tags) if tags else facts, keys, t, lo, hi, item, list(tags))
    found = items.groupBy(*keys, "__lo", "__hi").agg(F.count(F.lit(1)).alias(name), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in tags])
    return _attach(windows, found, keys, dict.fromkeys([name, *tags], 0))


def wide_window_item_counts(
    cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, lo: Column, hi: Column, item: str,
    split: tuple[str, list] | None = None, name: str = "n_items",
) -> DataFrame:
    """``window_item_counts`` by running counts, for windows that hold most of a key's facts: no fact is paired with a window."""
    col, values = split or (None, [])
    series = {name: F.lit(True), **{f"{name}_{v}": F.col(col) == v for v in values}}
    return distinct_in_windows(cohort, facts, keys, t, lo, hi, item, series)


def window_set(cohort: DataFrame, facts: list[DataFrame], keys: list[str], t: str, lo: Column, hi: Column, item: str, name: str = "items") -> DataFrame:
    """Count and sorted set of distinct items over several sources in [lo, hi]."""
    union = reduce(DataFrame.union, [f.select(*keys, t, item) for f in facts])
    windows, items = _window_items(cohort, union, keys, t, lo, hi, item)
    found = items.groupBy(*keys, "__lo", "__hi").agg(F.count(F.lit(1)).alias(f"{name}_count"), F.sort_array(F.collect_set(item)).alias(f"{name}_list"))
    return _attach(windows, found, keys, {f"{name}_count": 0})


def event_after(
    cohort: DataFrame, events: DataFrame, keys: list[str], index: str, t: str, months: int, lower: bool = True, name: str = "event",
) -> DataFrame:
    """Every cohort row with a flag and the first event date up to ``months`` after the index.

    ``lower=False`` drops the lower bound, so events before the index count as well.
    """
    until = F.add_months(F.to_date(index), months)
    if not lower:
        first = events.groupBy(*keys).agg(F.min(F.to_date(t)).alias("__first"))
        out = first.join(cohort, keys, "right")
        date = F.when(F.col("__first") <= until, F.col("__first"))
        return out.withColumns({name: F.coalesce(date.isNotNull().cast("int"), F.lit(0)), f"{name}_date": date}).drop("__first")
    windows = _windows(cohort, keys, F.col(index), until)
    daily = events.select(*keys, F.to_date(t).alias("__day")).distinct()
    found = _in_window(windows, daily, keys).groupBy(*keys, "__lo", "__hi").agg(F.lit(1).alias(name), F.min("__day").alias(f"{name}_date"))
    return _attach(windows, found, keys, {name: 0})


def window_sum(cohort: DataFrame, daily: DataFrame, keys: list[str], t: str, lo: Column, hi: Column, col: str, name: str | None = None) -> DataFrame:
    """Sum of a daily measure over [lo, hi], 0 where none."""
    name = name or f"{col}_sum"
    totals = daily.groupBy(*keys, F.to_date(t).alias("__day")).agg(F.sum(col).alias("__v"))
    windows = _windows(cohort, keys, lo, hi)
    found = _in_window(windows, totals, keys).groupBy(*keys, "__lo", "__hi").agg(F.sum("__v").alias(name))
    return _attach(windows, found, keys, {name: 0})


def ever_in(cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, lo: Column, hi: Column, pred: Column, name: str = "ever") -> DataFrame:
    """1 if some fact meeting ``pred`` lies in [lo, hi]."""
    hits = facts.where(pred).select(*keys, t, F.lit(1).alias(name))
    return flag_in_window(cohort, hits, keys, t, lo, hi, [name])


def exclude_if_any(cohort: DataFrame, facts: DataFrame, keys: list[str], pred: Column) -> DataFrame:
    """Cohort rows without any fact meeting ``pred``."""
    return cohort.join(facts.where(pred).select(*keys).distinct(), keys, "left_anti")


def offset_days(df: DataFrame, a: str, b: str, name: str = "offset") -> DataFrame:
    """Calendar days from ``a`` to ``b``."""
    return df.withColumn(name, F.datediff(b, a))
