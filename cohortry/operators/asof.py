"""Window totals by an as-of merge: running count at the last day of a window minus running count before its first.

Flags need one read only: a window holds a flagged day if the last one up to its end is not before its first day.

Facts are reduced to one row per key and day, window ends to their distinct days, and both are merged in one scan along the days. A key's
rows in that scan are bounded by the calendar, however many records or windows it has, and no record is copied into cells. The windows
then read the running totals of their two ends by equality.

Distinct items need one correction. Of the days on which an item occurs in a window all but its first repeat it, so

    distinct items = days of items in the window - repeats whose day before lies in the window too.

Repeats are pairs (day before, day) of one item. Those inside a window are counted over the few power-of-two stretches of days that make
up the window: within a stretch, the running count along the day before answers "how many not before the first day of the window".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import checkpoint

#: Stretches of up to 2**LEVELS days; more than the days of the years 1 to 9999.
LEVELS = 22
#: Days are counted from here, so that they are not negative.
ORIGIN = 719_528


def _position(day: Column) -> Column:
    return F.unix_date(day) + ORIGIN


def scanned_at(daily: DataFrame, probes: DataFrame, keys: list[str], at: str, measures: list[str], descending: bool = False, fn: str = "sum") -> DataFrame:
    """``running_at`` for frames that have each place at most once: they are scanned as they are, a place's own row before its probe."""
    fold = {"sum": F.sum, "max": F.max}[fn]
    nothing = [F.lit(0 if fn == "sum" else None).cast("long").alias(m) for m in measures]
    own = daily.select(*keys, at, *[F.col(m).cast("long").alias(m) for m in measures], F.lit(0).alias("__probe"))
    both = own.union(probes.select(*keys, at, *nothing, F.lit(1).alias("__probe")))
    along = Window.partitionBy(*keys).orderBy(F.col(at).desc() if descending else F.col(at).asc(), "__probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*keys, at, "__probe", *[fold(m).over(along).alias(m) for m in measures]).where("__probe = 1").drop("__probe")


def running_at(daily: DataFrame, probes: DataFrame, keys: list[str], at: str, measures: list[str], descending: bool = False) -> DataFrame:
    """(keys, at, measures): running sums of ``daily`` along ``at`` up to and including each distinct probe.

    Both frames have the keys and ``at``; ``daily`` also the measures. Rows of equal keys and place are combined before the scan.
    """
    nothing = [F.lit(0).cast("long").alias(m) for m in measures]
    own = daily.select(*keys, at, *[F.col(m).cast("long").alias(m) for m in measures], F.lit(0).alias("__probe"))
    both = own.union(probes.select(*keys, at, *nothing, F.lit(1).alias("__probe")))
    each = both.groupBy(*keys, at).agg(*[F.sum(m).alias(m) for m in measures], F.max("__probe").alias("__probe"))
    along = Window.partitionBy(*keys).orderBy(F.col(at).desc() if descending else F.col(at).asc()).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*keys, at, "__probe", *[F.sum(m).over(along).alias(m) for m in measures]).where("__probe = 1").drop("__probe")


def _ends(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct days that the windows ask for: the last day, and the one before the first."""
    return windows.select(*keys, F.explode(F.array("__hi", F.date_sub("__lo", 1))).alias("__day")).distinct()


def _read(windows: DataFrame, table: DataFrame, keys: list[str], at: Column, names: dict[str, str]) -> DataFrame:
    """``windows`` with columns of ``table`` (keys, __day, …) under new names, read at a day."""
    right = table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__day").alias("__at"), *[F.col(m).alias(n) for m, n in names.items()])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], at == F.col("__at"))
    return windows.join(right, same, "left").drop("__at", *[f"__k{i}" for i in range(len(keys))])


def window_totals(cohort: DataFrame, daily: DataFrame, keys: list[str], lo: Column, hi: Column, totals: dict[str, str]) -> DataFrame:
    """Cohort rows with the sums of whole-number measures of ``daily`` (keys, ``__day``, …; one row per day) over the days lo … hi; 0 without any.

    ``totals`` maps a measure to the name of its sum. Windows that are empty or open (null) have 0.
    """
    windows = cohort.withColumns({"__lo": F.to_date(lo), "__hi": F.to_date(hi)})
    valid = windows.where("__lo <= __hi")
    running = scanned_at(daily.where(F.col("__day").isNotNull()), _ends(valid, keys), keys, "__day", list(totals))
    read = _read(windows, running, keys, F.col("__hi"), {m: f"__h_{m}" for m in totals})
    read = _read(read, running, keys, F.date_sub("__lo", 1), {m: f"__l_{m}" for m in totals})
    inside = F.coalesce(F.col("__lo") <= F.col("__hi"), F.lit(False))
    sums = {n: F.when(inside, F.coalesce(F.col(f"__h_{m}"), F.lit(0)) - F.coalesce(F.col(f"__l_{m}"), F.lit(0))).otherwise(0).cast("long") for m, n in totals.items()}
    return read.select(*cohort.columns, *[c.alias(n) for n, c in sums.items()])


def window_flags(cohort: DataFrame, daily: DataFrame, keys: list[str], lo: Column, hi: Column, flags: dict[str, str]) -> DataFrame:
    """Cohort rows with 1/0: whether the 0/1 column of ``daily`` is 1 on any day of lo … hi. ``flags`` maps a column to its name.

    ``daily`` has one row per keys and ``__day``. Only the ends of the windows are merged with the days, and the windows read once.
    """
    windows = cohort.withColumns({"__lo": F.to_date(lo), "__hi": F.to_date(hi)})
    ends = windows.where("__lo <= __hi").select(*keys, F.col("__hi").alias("__day")).distinct()
    marked = daily.where(F.col("__day").isNotNull()).select(*keys, "__day", *[F.when(F.col(m) > 0, F.unix_date("__day")).alias(m) for m in flags])
    last = {m: f"__last_{m}" for m in flags}
    read = _read(windows, scanned_at(marked, ends, keys, "__day", list(flags), fn="max"), keys, F.col("__hi"), last)
    found = {n: (F.col("__lo") <= F.col("__hi")) & (F.col(last[m]) >= F.unix_date("__lo")) for m, n in flags.items()}
    return read.select(*cohort.columns, *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in found.items()])


def _stretches(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The power-of-two stretches (level, number) of days that make up first … last, at most two for each level up to ``levels``."""

    def level(j: int) -> Column:
        size = 1 << j
        a = F.shiftright(first + (size - 1), j)  # first whole stretch
        b = F.shiftright(last + 1, j)  # end of the last whole one
        odd = lambda c: c.bitwiseAND(1) == 1
        left = F.when((a < b) & odd(a), F.struct(F.lit(j).alias("level"), a.alias("node")))
        right = F.when((a < b) & odd(b), F.struct(F.lit(j).alias("level"), (b - 1).alias("node")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.array(*[level(j) for j in range(levels + 1)])))


def repeats_in_windows(spans: DataFrame, near: DataFrame, keys: list[str], measures: list[str], levels: int = LEVELS) -> DataFrame:
    """Per distinct window (keys, __lo, __hi): sums over the repeats (keys, __before, __day, __reach, measures) that lie inside it.

    A repeat stands in one stretch of each level, a window asks at most two of each. ``__reach`` is the length of the key's longest window
    in days: no stretch of a window is longer than the window.
    """
    own = F.sequence(F.lit(0), F.least(F.floor(F.log2(F.col("__reach") + 1)) + 1, F.lit(levels)).cast("int"))
    at = near.withColumn("level", F.explode(own)).withColumn("node", F.expr(f"shiftright(unix_date(__day) + {ORIGIN}, level)"))
    asked = spans.join(near.select(*keys).distinct(), keys, "left_semi")
    asked = asked.withColumn("__s", F.explode(_stretches(_position(F.col("__lo")), _position(F.col("__hi")), levels))).select(*keys, "__lo", "__hi", "__s.*")
    place = [*keys, "level", "node"]
    counts = running_at(at.withColumnRenamed("__before", "__d"), asked.withColumnRenamed("__lo", "__d").select(*place, "__d"), place, "__d", measures, descending=True)
    found = asked.join(counts.withColumnRenamed("__d", "__lo"), [*place, "__lo"])
    return found.groupBy(*keys, "__lo", "__hi").agg(*[F.sum(m).alias(m) for m in measures])


def distinct_in_windows(cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, lo: Column, hi: Column, item: str, series: dict[str, Column]) -> DataFrame:
    """Cohort rows with numbers of distinct items on the days lo … hi, one per series (name → which facts count); 0 without any.

    The repeats that are no further apart than their key's longest window are written once; most tables have few.
    """
    measures = [f"__m{i}" for i in range(len(series))]
    marks = [F.max(F.coalesce(c, F.lit(False)).cast("long")).alias(m) for m, c in zip(measures, series.values(), strict=True)]
    days = facts.where(F.col(item).isNotNull() & F.col(t).isNotNull()).groupBy(*keys, F.to_date(t).alias("__day"), F.col(item).alias("__item")).agg(*marks)
    daily = days.groupBy(*keys, "__day").agg(*[F.sum(m).alias(m) for m in measures])
    windows = cohort.withColumns({"__wlo": F.to_date(lo), "__whi": F.to_date(hi)})
    out = window_totals(windows, daily, keys, F.col("__wlo"), F.col("__whi"), {m: f"{m}_days" for m in measures})

    spans = windows.where("__wlo <= __whi").select(*keys, F.col("__wlo").alias("__lo"), F.col("__whi").alias("__hi")).distinct()
    seen = Window.partitionBy(*keys, "__item").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    placed = days.withColumns({f"{m}_before": F.max(F.when(F.col(m) == 1, F.col("__day"))).over(seen) for m in measures})
    longest = spans.groupBy(*keys).agg(F.max(F.datediff("__hi", "__lo")).alias("__reach"))

    def repeat(m: str) -> Column:
        own = [F.lit(int(m == x)).cast("long").alias(x) for x in measures]
        return F.when((F.col(m) == 1) & (F.datediff("__day", f"{m}_before") <= F.col("__reach")), F.struct(F.col(f"{m}_before").alias("__before"), *own))

    near = placed.where(F.coalesce(*[F.col(f"{m}_before") for m in measures]).isNotNull()).join(longest, keys)
    near = near.select(*keys, "__day", "__reach", F.inline(F.array_compact(F.array(*[repeat(m) for m in measures]))))
    near = checkpoint(near.groupBy(*keys, "__before", "__day", "__reach").agg(*[F.sum(m).alias(m) for m in measures]))
    reach = near.agg(F.max("__reach")).first()[0]
    if reach is None:
        return out.select(*cohort.columns, *[F.col(f"{m}_days").alias(n) for m, n in zip(measures, series, strict=True)])
    again = repeats_in_windows(spans, near, keys, measures, min(LEVELS, (reach + 1).bit_length())).withColumnsRenamed({"__lo": "__wlo", "__hi": "__whi", **{m: f"{m}_again" for m in measures}})
    out = out.join(again, [*keys, "__wlo", "__whi"], "left")
    return out.select(*cohort.columns, *[(F.col(f"{m}_days") - F.coalesce(F.col(f"{m}_again"), F.lit(0))).alias(n) for m, n in zip(measures, series, strict=True)])
