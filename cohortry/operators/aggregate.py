"""Grouped aggregation: one hash aggregate per call, medians through bracketed ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.scan import join_same_keys, prefix_scan

FUNCTIONS = (
    "avg", "mean", "sum", "stddev", "min", "max", "count", "median",
    "first", "last", "collect_list", "collect_set", "concat_ws",
)
_NUMERIC = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "stddev": F.stddev_samp}


def _as_list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def require_columns(df: DataFrame, cols) -> None:
    """Raise ``ValueError`` naming every column that the frame lacks."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")


def _ordered_values(col: str, order: list[str]) -> Column:
    """Non-null values of a group in ``order`` (ties by value)."""
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(col).alias("v"))
    rows = F.array_sort(F.collect_list(F.when(F.col(col).isNotNull(), row)))
    return F.transform(rows, lambda r: r["v"])


def _expression(col: str, fn: str, order: list[str], is_bool: bool) -> Column:
    value = F.col(col)
    if fn in _NUMERIC:
        return _NUMERIC[fn](value.cast("int") if is_bool else value)
    if fn == "count":
        return F.count(value)
    if fn == "min":
        return F.min(value)
    if fn == "max":
        return F.max(value)
    if fn in ("first", "last"):
        # The value itself breaks ties, so the pick does not depend on row arrival.
        rank = F.struct(*[F.col(c) for c in order], value)
        return (F.min_by if fn == "first" else F.max_by)(value, rank)
    if fn == "collect_set":
        return F.sort_array(F.collect_set(value))
    values = _ordered_values(col, order)
    return values if fn == "collect_list" else F.array_join(F.transform(values, lambda v: v.cast("string")), ";")


def aggregate(df: DataFrame, by: list[str], aggs: dict, order_by=None) -> DataFrame:
    """One row per group with columns ``<col>_<fn>``.

    ``aggs`` maps a column to one function or a list of them (see ``FUNCTIONS``). ``order_by`` orders first, last,
    collect_list and concat_ws. A collected list is one cell per group; where groups can outgrow a row,
    use ``ordered_list`` which spreads a list over rows.
    """
    by, order = _as_list(by), _as_list(order_by)
    plan = {c: _as_list(fns) for c, fns in aggs.items()}
    require_columns(df, [*by, *plan, *order])
    unknown = sorted({f for fns in plan.values() for f in fns} - set(FUNCTIONS))
    if unknown:
        raise ValueError(f"unknown aggregate functions: {unknown}")
    types = dict(df.dtypes)
    names, exprs, medians = [], [], []
    for col, fns in plan.items():
        for fn in fns:
            names.append(f"{col}_{fn}")
            if fn == "median":
                medians.append(col)
            else:
                exprs.append(_expression(col, fn, order, types[col] == "boolean").alias(names[-1]))
    out = df.groupBy(*by).agg(*exprs) if exprs else df.select(*by).distinct()
    if medians:
        numeric = df.withColumns({c: F.col(c).cast("int") for c in medians if types[c] == "boolean"})
        long = exact_quantiles(numeric, by, medians, {"median": 0.5})
        wide = long.groupBy(*by).agg(
            *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"{c}_median") for c in medians]
        )
        if by:
            out = join_same_keys(out, wide, by, "left")
        else:
            out = wide if not exprs else out.select("*", *[wide.select(f"{c}_median").scalar().alias(f"{c}_median") for c in medians])
    return out.select(*by, *names)


def aggregate_person(df: DataFrame, by: list[str], aggs: dict, person_keys: list[str], order_by=None) -> DataFrame:
    """``aggregate`` with the person keys always part of the grouping."""
    return aggregate(df, [*person_keys, *[c for c in _as_list(by) if c not in person_keys]], aggs, order_by)


def ordered_list(df: DataFrame, by: list[str], value: str, order: str, chunk: int = 1000) -> DataFrame:
    """Ordered values of each group as rows of at most ``chunk`` values: (by…, chunk_no, values).

    Concatenating the chunks gives the collect_list of the group. Positions come from a distributed scan over
    the counted order values, so neither a task nor a row ever holds a whole hot group.
    """
    require_columns(df, [*by, value, order])
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, order, value).agg(F.count(F.lit(1)).alias("__n"))
    per_key = rows.groupBy(*by, order).agg(F.sum("__n").alias("__m"))
    starts = prefix_scan(per_key, by, order, {"__end": ("sum", "__m")})
    placed = join_same_keys(rows, starts, [*by, order])
    # Rows sharing one order value are placed by value inside that order value.
    placed = prefix_scan(placed, [*by, order], value, {"__upto": ("sum", "__n")})
    placed = placed.withColumn("__pos", F.col("__end") - F.col("__m") + F.col("__upto") - F.col("__n"))
    # A run of equal values may cross chunk borders: cut it into one piece per chunk it touches.
    last = F.col("__pos") + F.col("__n") - 1
    pieces = placed.withColumn("__end_pos", last).select(
        *by, value, "__pos", "__end_pos",
        F.explode(F.sequence(F.floor(F.col("__pos") / chunk), F.floor(last / chunk))).alias("chunk_no"),
    )
    lo = F.greatest(F.col("__pos"), F.col("chunk_no") * chunk)
    hi = F.least(F.col("__end_pos"), (F.col("chunk_no") + 1) * chunk - 1)
    pieces = pieces.select(*by, "chunk_no", F.struct(lo.alias("p"), (hi - lo + 1).cast("int").alias("n"), F.col(value).alias("v")).alias("__piece"))
    grouped = pieces.groupBy(*by, "chunk_no").agg(F.array_sort(F.collect_list("__piece")).alias("__pieces"))
    return grouped.select(
        *by, "chunk_no", F.flatten(F.transform("__pieces", lambda p: F.array_repeat(p["v"], p["n"]))).alias("values")
    )


def pivot_count(df: DataFrame, by: list[str], col: str, values: list, prefix: str = "") -> DataFrame:
    """Row counts per group and pivot value, 0 where absent."""
    counts = [F.count(F.when(F.col(col) == v, 1)).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*by).agg(*counts)


def count_distinct_ids(df: DataFrame, by: list[str], cols: list[str], prefix: str = "n_") -> DataFrame:
    """Exact numbers of distinct whole numbers in several columns per group, in one pass; nulls do not count.

    Values are bits of 4 KB pages. A task sets the bits of its own rows before the shuffle, so what is sent depends on the pages in use and not on the
    rows, and a hot group is spread over its pages. Pages are dense where ids are; values scattered over a wide range take a page each.
    """
    require_columns(df, [*by, *cols])
    cells = F.array(*[F.struct(F.lit(i).alias("__c"), F.col(c).cast("long").alias("__v")) for i, c in enumerate(cols)])
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    long = df.select(*keys, F.inline(cells))
    # a group without any value keeps a row, under the page of the null value
    pages = long.groupBy(*names, "__c", F.bitmap_bucket_number("__v").alias("__page")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("__v"))).alias("__n"))
    sums = [F.coalesce(F.sum(F.when((F.col("__c") == i) & F.col("__page").isNotNull(), F.col("__n"))), F.lit(0)).alias(f"{prefix}{c}") for i, c in enumerate(cols)]
    return pages.groupBy(*names).agg(*sums).withColumnsRenamed(dict(zip(names, by, strict=True)))


def count_distinct(df: DataFrame, by: list[str], col: str, name: str = "n_distinct") -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(col).alias(name))


def dedupe(df: DataFrame, keys: list[str], order_by=None) -> DataFrame:
    """One row per key; the first under ``order_by``, with the remaining columns as tie break."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = [*_as_list(order_by), *[c for c in rest if c not in _as_list(order_by)]]
    row = F.struct(*rest)
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def earliest_of(sources: list[tuple[DataFrame, str]], by: list[str], name: str = "earliest") -> DataFrame:
    """Minimum date per source, then over all sources."""
    mins = [df.groupBy(*by).agg(F.min(date).alias(name)) for df, date in sources]
    return reduce(DataFrame.unionByName, mins).groupBy(*by).agg(F.min(name).alias(name))


def extent(df: DataFrame, cols: list[str]) -> DataFrame:
    """Global minimum and maximum of each column in one row."""
    return df.agg(*[fn(c).alias(f"{c}_{tag}") for c in cols for tag, fn in (("min", F.min), ("max", F.max))])


def any_flag(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """1 if any row of the group has the flag set, else 0."""
    return df.groupBy(*by).agg(*[F.max(F.coalesce(F.col(f).cast("int"), F.lit(0))).alias(f) for f in flags])


def set_size(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Number of distinct non-null values; the values are never collected."""
    return count_distinct(df, by, col, f"{col}_set_size")


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def rate_by(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Rows, flagged rows and their ratio per group."""
    n, hits = F.count(F.lit(1)), F.sum(F.coalesce(F.col(flag).cast("int"), F.lit(0)))
    return df.groupBy(*by).agg(n.alias("n"), hits.alias("n_flag"), (hits / n).alias("rate"))


def describe(df: DataFrame, col: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact quantiles and max of one column, as one row."""
    probs = quantiles or {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    moments = df.agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("stddev"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    cuts = exact_quantiles(df, [], [col], probs).drop("column")
    cut = cuts.select(F.struct(*[F.col(p).alias(f"q{i}") for i, p in enumerate(probs)])).scalar()
    return moments.select(
        "count", "mean", "stddev", "min", *[cut.getField(f"q{i}").alias(p) for i, p in enumerate(probs)], "max"
    )


def count_or_zero(cohort: DataFrame, facts: DataFrame, keys: list[str], col: str, name: str = "n") -> DataFrame:
    """Distinct ``col`` values per cohort row, 0 for those without facts."""
    counts = facts.groupBy(*keys).agg(F.countDistinct(col).alias(name))
    return cohort.join(counts, keys, "left").na.fill(0, [name])


def row_counts(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
