"""Projection, filters, eligibility and null handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.aggregate import require_columns


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Select and rename, ``{new: old}``."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def rename_suffix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Replace a column-name suffix wherever it occurs."""
    return df.withColumnsRenamed({c: c[: len(c) - len(old)] + new for c in df.columns if old and c.endswith(old)})


def in_range(col: Column, lo, hi) -> Column:
    """Half-open range test ``lo <= col < hi``."""
    return (col >= lo) & (col < hi)


def eligible(df: DataFrame, criteria: list) -> DataFrame:
    """Rows meeting every criterion (SQL text or Column)."""
    return reduce(lambda d, c: d.where(c), criteria, df)


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any grain column is null."""
    return df.na.drop(subset=cols)


def any_concept(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows where a boolean concept is true or a value concept is present."""
    require_columns(df, labels)
    types = dict(df.dtypes)
    tests = [F.col(c) if types[c] == "boolean" else F.col(c).isNotNull() for c in labels]
    return df.where(reduce(lambda a, b: a | b, tests))


def text_filter(df: DataFrame, col: str, like=None, contains=None, isin=None, negate: bool = False) -> DataFrame:
    """LIKE / contains / IN filter, optionally negated (null text never passes)."""
    tests = []
    if like is not None:
        tests.append(F.col(col).like(like))
    if contains is not None:
        tests.append(F.contains(F.col(col), F.lit(contains)))
    if isin is not None:
        tests.append(F.col(col).isin(list(isin)))
    if not tests:
        raise ValueError("text_filter needs like, contains or isin")
    hit = reduce(lambda a, b: a & b, tests)
    return df.where(~hit if negate else hit)


def active_at(noted: Column, resolved: Column, status: Column, at: Column) -> Column:
    """Noted by ``at``, not resolved before it, and not deleted."""
    open_then = resolved.isNull() | (resolved >= at)
    return (noted <= at) & open_then & (F.coalesce(status, F.lit("")) != "Deleted")


def exclude_any(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows where none of the flags is set; a null flag counts as not set."""
    set_flags = [F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags]
    return df.where(reduce(lambda a, b: a & b, [f == 0 for f in set_flags]))


def attrition(df: DataFrame, criteria: list[tuple[str, object]]) -> DataFrame:
    """Rows left after each criterion in turn, from one pass: (step, criterion, remaining)."""
    counts, passed = [F.count(F.lit(1)).alias("c0")], F.lit(True)
    for i, (_, test) in enumerate(criteria, 1):
        passed = passed & F.coalesce(F.expr(test) if isinstance(test, str) else test, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).alias(f"c{i}"))
    names = ["all", *[n for n, _ in criteria]]
    steps = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("criterion"), F.col(f"c{i}").alias("remaining")) for i, n in enumerate(names)]
    return df.agg(*counts).select(F.inline(F.array(*steps)))


def recode(col: Column, cases: dict, default=None) -> Column:
    """CASE recode of exact values; ``default`` may be a Column."""
    items = list(cases.items())
    out = reduce(lambda w, kv: w.when(col == kv[0], kv[1]), items[1:], F.when(col == items[0][0], items[0][1]))
    return out.otherwise(default)


def null_if(df: DataFrame, cols: list[str], sentinel) -> DataFrame:
    """Turn a sentinel value into null; columns whose type cannot hold it are left alone."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel).try_cast(types[c])) for c in cols})


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill nulls per column."""
    return df.na.fill(values)


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``a`` also in ``b``, in the order of ``a``."""
    return [c for c in a.columns if c in b.columns]
