"""Outcome statistics: prevalence, contingency tests, rank test, correlation, distributions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.probability import Z95, chi_square_sf, ln_factorial, normal_two_sided
from cohortry.operators.aggregate import require_columns
from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.scan import join_same_keys, prefix_scan


def interval(yes: Column, n: Column, method: str = "wilson") -> tuple[Column, Column]:
    """95 % interval of a proportion: Wilson score or Wald."""
    p = yes / n
    if method == "wald":
        half = Z95 * F.sqrt(p * (1 - p) / n)
        return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))
    if method != "wilson":
        raise ValueError("method must be wilson or wald")
    z2 = Z95 * Z95
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return centre - half, centre + half


def prevalence(df: DataFrame, by: list[str], flag: str, method: str = "wilson") -> DataFrame:
    """Rows with and without the flag, its rate and 95 % interval per group (a null flag counts as no)."""
    hit = F.coalesce(F.col(flag).cast("int"), F.lit(0))
    s = df.groupBy(*by).agg(F.sum(hit).alias("yes"), F.sum(1 - hit).alias("no"))
    return _with_rate(s, method)


def _with_rate(s: DataFrame, method: str) -> DataFrame:
    n = F.col("yes") + F.col("no")
    low, high = interval(F.col("yes"), n, method)
    return s.select("*", (F.col("yes") / n).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def outcome_table(df: DataFrame, arm: str, outcomes: list[str], method: str = "wilson") -> DataFrame:
    """Long outcome table (outcome, arm, yes, no, rate, ci_low, ci_high) from one pass over the rows."""
    require_columns(df, [arm, *outcomes])
    hits = {o: F.coalesce(F.col(o).cast("int"), F.lit(0)) for o in outcomes}
    s = df.groupBy(arm).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(h).alias(f"__{o}") for o, h in hits.items()])
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"__{o}").alias("yes"), (F.col("__n") - F.col(f"__{o}")).alias("no")) for o in outcomes])
    return _with_rate(s.select(F.inline(rows), F.col(arm).alias("arm")).select("outcome", "arm", "yes", "no"), method)


def select_outcomes(table: DataFrame, names: list[str], arms: list[str] | None = None) -> DataFrame:
    """Rows of chosen outcomes (and arms) of an outcome table."""
    out = table.where(F.col("outcome").isin(names))
    return out if arms is None else out.where(F.col("arm").isin(arms))


def pairwise_2x2(table: DataFrame) -> DataFrame:
    """2×2 cells a, b, c, d for every pair of arms of each outcome, as input to ``fisher_2x2``.

    An outcome table has one row per outcome and arm, so the pairs are those of the arms.
    """
    left = table.select("outcome", F.col("arm").alias("arm_1"), F.col("yes").alias("a"), F.col("no").alias("b"))
    right = table.select("outcome", F.col("arm").alias("arm_2"), F.col("yes").alias("c"), F.col("no").alias("d"))
    return left.join(right, "outcome").where(F.col("arm_1") < F.col("arm_2"))


STEP = 10_000


def fisher_2x2(table: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Two-sided Fisher exact p value and sample odds ratio for each row of 2×2 counts.

    Sums the hypergeometric terms not larger than the observed one. Terms further than 40 standard deviations (plus 50) from the
    mean are below the smallest double, so the sum is limited to that range; it is laid out in runs of 10,000.
    """
    names = dict(zip((a, b, c, d), ("__a", "__b", "__c", "__d")))
    t = table.select(*[F.col(x).cast("double").alias(n) for x, n in names.items()]).distinct()
    r1, r2, c1 = F.col("__a") + F.col("__b"), F.col("__c") + F.col("__d"), F.col("__a") + F.col("__c")
    total = r1 + r2
    mean = r1 * c1 / total
    sd = F.sqrt(mean * (r2 / total) * ((total - c1) / F.greatest(total - 1, F.lit(1.0))))
    t = t.withColumns({
        "__k0": F.greatest(F.lit(0.0), c1 - r2, F.floor(mean - 40 * sd - 50)), "__k1": F.least(r1, c1, F.ceil(mean + 40 * sd + 50)),
    })

    # The factorials of the margins are computed once per table, those of the cells once per term.
    margins = ln_factorial(r1) + ln_factorial(r2) + ln_factorial(c1) + ln_factorial(total - c1) - ln_factorial(total)

    def ln_cells(k):
        return ln_factorial(k) + ln_factorial(r1 - k) + ln_factorial(c1 - k) + ln_factorial(r2 - c1 + k)

    t = t.withColumns({"__margins": margins, "__obs": ln_cells(F.col("__a"))})
    runs = t.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__k1") - F.col("__k0")) / STEP).cast("int"))))
    start = (F.col("__k0") + F.col("__run") * STEP).cast("long")
    stop = F.least(F.col("__k1").cast("long"), start + (STEP - 1))
    terms = runs.withColumn("__k", F.explode(F.sequence(start, stop))).withColumn("__ln", ln_cells(F.col("__k").cast("double")))
    kept = F.when(F.col("__ln") >= F.col("__obs") - 1e-7, F.exp(F.col("__margins") - F.col("__ln"))).otherwise(0.0)
    sums = terms.groupBy("__a", "__b", "__c", "__d").agg(F.sum(kept).alias("__p"))
    odds = F.when(F.col("__b") * F.col("__c") > 0, F.col("__a") * F.col("__d") / (F.col("__b") * F.col("__c")))
    keyed = table.withColumns({n: F.col(x).cast("double") for x, n in names.items()})
    tested = join_same_keys(keyed, sums, list(names.values()), "left")
    return tested.select(*table.columns, odds.alias("odds_ratio"), F.least(F.col("__p"), F.lit(1.0)).alias("p_value"))


def fisher_mc(df: DataFrame, row: str, col: str, n: int = 2000, seed: int = 1) -> DataFrame:
    """Monte-Carlo Fisher test of an r×c table: p value and its standard error, as one row.

    Only the table of counts matters for the test, so tables with the observed margins are drawn on the executors (``n`` in all)
    and compared by probability with the observed one. Category combinations must be countable on one machine.
    """
    counts = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    margin_r = counts.groupBy(row).agg(F.sum("n").alias("m"))
    margin_c = counts.groupBy(col).agg(F.sum("n").alias("m"))
    bound = 10_000
    rows = [r["m"] for r in margin_r.orderBy(row).limit(bound + 1).collect()]
    cols = [r["m"] for r in margin_c.orderBy(col).limit(bound + 1).collect()]
    if len(rows) > bound or len(cols) > bound:
        raise ValueError("too many categories for a contingency test")
    if sum(rows) >= 10**9:
        raise ValueError("use chi_square for a billion rows or more")
    observed = counts.agg(F.sum(ln_factorial(F.col("n"))).alias("s")).first()["s"] or 0.0

    def draw(batches):
        import math

        import numpy as np
        import pandas as pd

        for pdf in batches:
            hits = []
            for i in pdf["id"]:
                rng, left, s = np.random.default_rng([seed, int(i)]), np.array(cols), 0.0
                for m in rows[:-1]:
                    cells = rng.multivariate_hypergeometric(left, m, method="marginals")
                    left = left - cells
                    s += sum(math.lgamma(x + 1.0) for x in cells)
                s += sum(math.lgamma(x + 1.0) for x in left)
                hits.append(int(s >= observed - 1e-7))
            yield pd.DataFrame({"hit": hits})

    sims = df.sparkSession.range(n).mapInPandas(draw, "hit int")
    p = (F.sum("hit") + 1) / F.lit(n + 1.0)
    return sims.agg(p.alias("p_value")).select("p_value", F.sqrt(F.col("p_value") * (1 - F.col("p_value")) / n).alias("std_error"))


def mann_whitney(df: DataFrame, arm: str, value: str, first, second) -> DataFrame:
    """Mann–Whitney U of two arms with tie-corrected normal p value, as one row (nulls are dropped).

    Values are counted first; ranks come from running counts along the distinct values.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(arm).isin(first, second)).select(F.col(value).cast("double").alias("v"), F.col(arm).alias("__arm"))
    counts = rows.groupBy("v").agg(F.count(F.when(F.col("__arm") == first, 1)).alias("n1"), F.count(F.when(F.col("__arm") == second, 1)).alias("n2"))
    ranked = prefix_scan(counts, [], "v", {"upto": ("sum", "n2")})
    t = F.col("n1") + F.col("n2")
    s = ranked.agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"),
        F.sum(F.col("n1") * (F.col("upto") - F.col("n2") / 2.0)).alias("u"),
        F.sum(F.pow(t.cast("double"), F.lit(3.0)) - t).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    s = s.withColumn("sigma", F.sqrt(n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * (total - 1)))))
    s = s.withColumn("z", F.when(F.col("sigma") > 0, (F.col("u") - n1 * n2 / 2) / F.col("sigma")))
    return s.select("n1", "n2", "u", "z", F.when(F.col("sigma") == 0, 1.0).otherwise(normal_two_sided(F.col("z"))).alias("p_value"))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def corr_matrix(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """Pearson correlations in long form (x, y, corr) from one aggregate; with ``target`` only pairs with it, sorted."""
    require_columns(df, cols)
    pairs = [(c, target) for c in cols if c != target] if target else list(combinations(cols, 2))
    one = df.agg(*[_finite(F.corr(x, y)).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    cells = []
    for i, (x, y) in enumerate(pairs):
        cells.append((x, y, F.col(f"c{i}")))
        if target is None:
            cells.append((y, x, F.col(f"c{i}")))
    if target is None:
        cells += [(c, c, F.lit(1.0)) for c in cols]
    out = one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), v.alias("corr")) for x, y, v in cells])))
    return out.orderBy(F.col("corr").desc_nulls_last(), "x") if target else out


def corr_of_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlations between the rows of the correlation matrix."""
    wide = corr_matrix(df, cols).groupBy("x").agg(*[F.max(F.when(F.col("y") == c, F.col("corr"))).alias(c) for c in cols])
    return corr_matrix(wide, cols)


def chi_square(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Chi-square test of each categorical feature against the label: (feature, statistic, dof, p_value).

    Margins and cells come from one grouped count, whatever the number of rows.
    """
    require_columns(df, [*features, label])
    long = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("__y"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
    ).where(F.col("value").isNotNull())
    cells = long.groupBy("feature", "value", "__y").agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("feature", "__y").agg(F.sum("o").alias("c"))
    sizes = rows.groupBy("feature").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("nr"))
    # sum (o-e)²/e = sum o²/e - n: empty cells add nothing, so only observed cells are needed
    met = cells.join(rows, ["feature", "value"]).join(cols, ["feature", "__y"])
    parts = met.groupBy("feature").agg(F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    classes = cols.groupBy("feature").agg(F.count(F.lit(1)).alias("nc"))
    out = parts.join(sizes, "feature").join(classes, "feature")
    stat, dof = F.col("n") * (F.col("s") - 1), (F.col("nr") - 1) * (F.col("nc") - 1)
    out = out.select("feature", F.greatest(stat, F.lit(0.0)).alias("statistic"), dof.alias("dof"))
    return out.withColumn("p_value", F.when(F.col("dof") > 0, chi_square_sf(F.col("statistic"), F.col("dof"))))


def distribution(dfs: dict[str, DataFrame], col: str, quantiles: dict[str, float]) -> DataFrame:
    """Rows, mean and exact quantiles of a column per named group."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("group"), F.col(col)) for name, d in dfs.items()])
    base = rows.groupBy("group").agg(F.count(col).alias("n"), F.avg(col).alias("mean"))
    return join_same_keys(base, exact_quantiles(rows, ["group"], [col], quantiles).drop("column"), ["group"], "left")


def histogram(df: DataFrame, col: str) -> DataFrame:
    """Rows per integer value."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias(col)).agg(F.count(F.lit(1)).alias("n"))
