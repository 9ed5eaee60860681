"""Column expressions: text, dates, arrays and lookups. All are built-in Spark expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters removed when free text is cleaned before matching.
STRIPPED = ".*:-()"
# The white space trimmed at both ends (ASCII and Unicode).
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _or(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


# Text ------------------------------------------------------------------------------------------

def clean_string(c: Column) -> Column:
    """Null to '', drop ``.*:-()``, trim white space, lower-case, collapse runs of blanks."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "[" + re.escape(STRIPPED) + "]", "")
    return F.regexp_replace(F.lower(F.trim(bare, F.lit(SPACES))), " {2,}", " ")


def zero_pad_front(c: Column, n: int = 3) -> Column:
    """Last ``n`` characters of the zero-padded text."""
    return F.right(F.concat(F.lit("0" * n), c.cast("string")), F.lit(n))


def split_at(c: Column, delimiter: str, i: int) -> Column:
    """Part ``i`` (from 0) of a delimited text; null if there is none."""
    return F.get(F.split(c, re.escape(delimiter)), F.lit(i))


def derive_key(c: Column, rules: list[tuple[Column, int, int]], default: tuple[int, int]) -> Column:
    """Substring whose (start, length) depends on the first rule met; a negative length counts from the end."""

    def cut(start, length):
        return F.substring(c, F.lit(start), F.length(c) + length if length < 0 else F.lit(length))

    out = cut(*default)
    for test, start, length in reversed(rules):
        out = F.when(test, cut(start, length)).otherwise(out)
    return out


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def regex_first(c: Column, patterns: list[str], group: int = 0) -> Column:
    """Match of the first pattern that occurs in the text, in pattern order; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


def coalesce_first(cols: list[Column], delimiter: str | None = None) -> Column:
    """First non-null column, or the first part of its delimited list."""
    value = F.coalesce(*cols)
    return value if delimiter is None else F.split_part(value, F.lit(delimiter), F.lit(1))


def phrase_tier(c: Column, tiers: list[tuple[list[str], object]]) -> Column:
    """Value of the first tier with a phrase occurring anywhere in the lower-cased text; null if none."""
    low = F.lower(c)
    out = F.lit(None)
    for phrases, value in reversed(tiers):
        pattern = "|".join(re.escape(p) for p in phrases)
        out = F.when(low.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def phrase_exact(c: Column, tiers: list[tuple[list[str], object]], default=None) -> Column:
    """Value of the first tier holding exactly this text."""
    out = F.lit(default)
    for phrases, value in reversed(tiers):
        out = F.when(c.isin(phrases), F.lit(value)).otherwise(out)
    return out


# Dates -----------------------------------------------------------------------------------------

def day_diff(a: Column, b: Column) -> Column:
    """Calendar days from b to a."""
    return F.datediff(a, b)


def day_add(c: Column, days) -> Column:
    return F.date_add(c, days)


def day_sub(c: Column, days) -> Column:
    return F.date_sub(c, days)


def _seconds(c: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def duration_days(start: Column, end: Column, digits: int = 2) -> Column:
    """Days between two timestamps from whole seconds, rounded."""
    return F.round((_seconds(end) - _seconds(start)) / 86400, digits)


def frac_days(a: Column, b: Column) -> Column:
    """Fractional days from b to a at microsecond precision."""
    return F.timestamp_diff("MICROSECOND", b, a) / F.lit(86400000000.0)


def shift(c: Column, days: int = 0, months: int = 0) -> Column:
    """Date shifted by calendar months (clamped to the month end), then days."""
    return F.date_add(F.add_months(c, months), days)


def part(c: Column, unit: str) -> Column:
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}
    if unit not in parts:
        raise ValueError(f"unknown part {unit!r}")
    return parts[unit](c)


def age_at(event: Column, birth: Column) -> Column:
    """Age in years with one decimal."""
    return F.round(F.datediff(event, birth) / F.lit(365.25), 1)


# Numbers ---------------------------------------------------------------------------------------

def to_number(c: Column, kind: str = "double") -> Column:
    """Cast that yields null on text that is not a number."""
    return c.try_cast(kind)


def _with_scalars(df: DataFrame, stats: list[Column], build) -> DataFrame:
    """Add columns computed from a one-row aggregate of the same frame."""
    one = df.agg(*stats)
    row = one.select(F.struct(*one.columns)).scalar()
    return df.withColumns(build({c: row.getField(c) for c in one.columns}))


def min_max(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Scale columns to 0…1; a constant column becomes 0."""
    stats = [fn(c).alias(f"{c}__{tag}") for c in cols for tag, fn in (("lo", F.min), ("hi", F.max))]

    def build(s):
        out = {}
        for c in cols:
            span = s[f"{c}__hi"] - s[f"{c}__lo"]
            out[c + suffix] = F.when(F.col(c).isNull(), None).when(span == 0, 0.0).otherwise((F.col(c) - s[f"{c}__lo"]) / span)
        return out

    return _with_scalars(df, stats, build)


def z_score(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Standardise by population mean and deviation; a constant column becomes 0."""
    stats = [fn(c).alias(f"{c}__{tag}") for c in cols for tag, fn in (("m", F.avg), ("s", F.stddev_pop))]

    def build(s):
        out = {}
        for c in cols:
            centred = F.col(c) - s[f"{c}__m"]
            out[c + suffix] = F.when(s[f"{c}__s"] == 0, centred).otherwise(centred / s[f"{c}__s"])
        return out

    return _with_scalars(df, stats, build)


# Arrays ----------------------------------------------------------------------------------------

def nth_distinct(a: Column, n: int) -> Column:
    """n-th (from 1) distinct element in array order; null if there are fewer."""
    return F.try_element_at(F.array_distinct(a), F.lit(n))


def first_of(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def explode_col(df: DataFrame, c: str) -> DataFrame:
    """One row per array element; rows with an empty or null array drop out."""
    return df.withColumn(c, F.explode(c))


def any_in(a: Column, values: list) -> Column:
    """True if the array holds any of the values."""
    return F.coalesce(F.arrays_overlap(a, F.array(*[F.lit(v) for v in values])), F.lit(False))


def any_within(a: Column, at: Column, months: int) -> Column:
    """True if some date d of the array has d < at < d + months."""
    return F.coalesce(F.exists(a, lambda d: (d < at) & (at < F.add_months(d, months))), F.lit(False))


def all_in(a: Column, values: list) -> Column:
    """True if every element is one of the values."""
    return F.forall(a, lambda x: F.coalesce(x.isin(list(values)), F.lit(False)))


def any_without(a: Column, keywords: list[str]) -> Column:
    """True if some element contains none of the keywords (case-insensitive)."""
    return F.exists(a, lambda x: ~_or([F.contains(F.lower(x), F.lit(k.lower())) for k in keywords]))


def first_match(dates: Column, states: Column, state, lo: Column, hi: Column) -> Column:
    """Date at the first position where the state equals ``state`` and lo <= date <= hi."""
    pairs = F.zip_with(dates, states, lambda d, s: F.struct(d.alias("d"), s.alias("s")))
    hits = F.filter(pairs, lambda p: (p["s"] == state) & (p["d"] >= lo) & (p["d"] <= hi))
    return F.try_element_at(hits, F.lit(1))["d"]


def token_max(c: Column, delimiter: str, levels: dict[str, int]) -> Column:
    """Largest level among the delimited tokens; unknown tokens are skipped, none known gives null."""
    lookup = _literal_map(levels)
    return F.array_max(F.transform(F.split(c, re.escape(delimiter)), lambda x: F.try_element_at(lookup, F.trim(x))))


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def recode_map(c: Column, mapping: dict, default=None) -> Column:
    """Dictionary lookup; unknown or null keys give ``default``."""
    found = F.when(c.isNotNull(), F.try_element_at(_literal_map(mapping), c))
    return found if default is None else F.coalesce(found, F.lit(default))


def register_sql(spark) -> None:
    """Make ``zero_pad_front(text, n)`` callable from SQL as a native SQL function."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION zero_pad_front(s STRING, n INT) RETURNS STRING RETURN right(concat(repeat('0', n), s), n)")
