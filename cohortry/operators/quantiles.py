"""Exact quantiles by bracketing: a mergeable sketch says between which two values a wanted rank lies, and only those are ranked.

One aggregate gives each group its number of values and, for each wanted quantile, a lower and an upper value from a Greenwald-Khanna
sketch, whose rank error is bounded. A second pass counts what lies below the bracket and, value by value, what lies inside. Running
counts within the bracket then hold the wanted ranks. A bracket is ``2 * MARGIN`` of its group wide, besides repeated values, so neither
a shuffle nor a task sees most of a large group. Groups of at most ``SMALL`` values are their own bracket, since there the error could
exceed the distance of neighbouring ranks. The sketches of groups are written before they meet the values, so that the engine knows their
size: few of them are broadcast, and no group's values are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.scan import join_same_keys
from cohortry.session import written

ACCURACY = 10_000
SMALL = 10_000
#: Twice the sketch's rank error on either side, and the rank by which an interpolated position can be off it.
MARGIN = 2 / ACCURACY + 1 / SMALL


def bracket_counts(df: DataFrame, by: list[str], cols: list[str], probs: list[float], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """(by…, __c, __part, __total, __value, __n): rows of each value inside a bracket, and under a null value those below it.

    ``__c`` numbers the column, ``__part`` the probability; -1 is the bracket of a small group, shared by all probabilities.
    """
    margin = 2 / accuracy + 1 / small
    wanted = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    values = df.select(*by, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(cols)])

    def sketch(i: int) -> Column:
        return F.struct(F.count(f"__v{i}").alias("n"), F.percentile_approx(f"__v{i}", wanted, accuracy).alias("q"))

    sketches = values.groupBy(*by).agg(F.struct(*[sketch(i).alias(f"c{i}") for i in range(len(cols))]).alias("__s"))
    # one row for the whole table is a scalar; the sketches of groups are joined by their keys
    both = join_same_keys(values, written(sketches), by) if by else values.withColumn("__s", sketches.scalar())

    def places(i: int) -> list[Column]:
        v, n, q = F.col(f"__v{i}"), F.col(f"__s.c{i}.n"), F.col(f"__s.c{i}.q")
        place = lambda part, value: F.struct(F.lit(i).alias("__c"), F.lit(part).alias("__part"), n.alias("__total"), value.alias("__value"))
        none = F.lit(None).cast("double")
        out = [F.when(v.isNotNull() & (n <= small), place(-1, v))]
        for k in range(len(probs)):
            lo, hi = q[2 * k], q[2 * k + 1]
            out.append(F.when(v.isNotNull() & (n > small) & (v <= hi), place(k, F.when(v >= lo, v).otherwise(none))))
        return out

    some = F.array_compact(F.array(*[p for i in range(len(cols)) for p in places(i)]))
    keys = [*by, "__c", "__part", "__total"]
    return both.select(*by, F.inline(some)).groupBy(*keys, "__value").agg(F.count(F.lit(1)).alias("__n"))


def exact_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: dict[str, float], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """Exact interpolated quantiles of several columns per group, in long form (by…, column, <probs>…).

    ``probs`` maps names to probabilities. Nulls are ignored, and a column without values in a group has no row. Null keys are a group.
    """
    counts = bracket_counts(df, by, cols, list(probs.values()), small, accuracy)
    keys = [*by, "__c", "__part", "__total"]
    along = Window.partitionBy(*keys).orderBy(F.col("__value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__end", F.sum("__n").over(along)).where(F.col("__value").isNotNull())

    def at(k: int, position: Column) -> Column:
        here = F.col("__part").isin(-1, k) & (position >= F.col("__end") - F.col("__n")) & (position < F.col("__end"))
        return F.max(F.when(here, F.col("__value")))

    picks = []
    for k, p in enumerate(probs.values()):
        position = F.lit(float(p)) * (F.col("__total") - 1)
        picks += [at(k, F.floor(position)).alias(f"__lo{k}"), at(k, F.ceil(position)).alias(f"__hi{k}"), F.max(position - F.floor(position)).alias(f"__w{k}")]
    found = ranked.groupBy(*by, "__c").agg(*picks)

    def value(k: int) -> Column:
        lo, hi = F.col(f"__lo{k}"), F.col(f"__hi{k}")
        missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
        return F.when(lo.isNull() | hi.isNull(), missed).otherwise(lo + (hi - lo) * F.col(f"__w{k}"))

    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("__c") + 1).alias("column")
    return found.select(*by, name, *[value(k).alias(n) for k, n in enumerate(probs)])
