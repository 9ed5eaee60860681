"""Propensity scores, nearest-neighbour matching and balance checks.

Matching is exact and never pairs whole groups: one-dimensional neighbours come from two running scans along the score,
multivariate neighbours from a grid whose cell width follows the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalars import z_score
from cohortry.operators.aggregate import require_columns
from cohortry.operators.glm import Logit, fit_logits, score_sums
from cohortry.operators.scan import prefix_scan
from cohortry.session import checkpoint


def propensity(df: DataFrame, treat: str, covariates: list[str], reg: float = 0.0, max_iter: int = 100) -> DataFrame:
    """Add ``score`` (probability of treatment) and ``logit`` from a class-balanced logistic model."""
    model = propensity_models(df, treat, {"": covariates}, reg, max_iter)[""]
    return df.withColumns({"score": model.probability(), "logit": model.logit()})


def propensity_models(df: DataFrame, treat: str, sets: dict[str, list[str]], reg: float = 0.0, max_iter: int = 100) -> dict[str, Logit]:
    """A class-balanced logistic model for each named set of covariates, all fitted in the same passes over the rows."""
    covariates = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    require_columns(df, [treat, *covariates])
    rows = checkpoint(df.select(treat, *covariates))
    weight = _arm_weight(treat, _arm_sizes(rows, treat))
    models = fit_logits(rows, treat, covariates, [weight] * len(sets), masks=list(sets.values()), ridge=reg, max_iter=max_iter)
    return dict(zip(sets, models, strict=True))


def _arm_sizes(df: DataFrame, treat: str) -> dict[int, int]:
    sizes = {r[treat]: r["n"] for r in df.where(F.col(treat).isin(0, 1)).groupBy(treat).agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        raise ValueError("both arms must be present")
    return sizes


def _arm_weight(treat: str, sizes: dict[int, int]) -> Column:
    """Weights under which both arms count the same."""
    total = sum(sizes.values())
    return F.when(F.col(treat) == 1, total / (2.0 * sizes[1])).when(F.col(treat) == 0, total / (2.0 * sizes[0]))


def propensity_equations(df: DataFrame, treat: str, covariates: list[str]) -> DataFrame:
    """(term, total, size) of the score equations of ``propensity`` without a penalty; totals are zero but for rounding."""
    model = propensity_models(df, treat, {"": covariates})[""]
    return score_sums(df, treat, model, _arm_weight(treat, _arm_sizes(df, treat)))


def match_caliper(df: DataFrame, id: str, treat: str, score: str, caliper: float) -> DataFrame:
    """Nearest control of each treated unit on a score, with replacement: (treated, control, distance).

    Only pairs within the caliper are returned; equal distances go to the smallest control id. Scores are reduced to
    distinct values; the last control at or below and the first at or above each value come from two scans, so
    the work is linear whatever the score distribution.
    """
    require_columns(df, [id, treat, score])
    rows = df.where(F.col(score).isNotNull()).select(F.col(id).alias("__id"), F.col(treat).alias("__t"), F.col(score).cast("double").alias("s"))
    values = rows.groupBy("s").agg(F.min(F.when(F.col("__t") == 0, F.col("__id"))).alias("c"), F.max("__t").alias("__t"))
    values = values.withColumn("here", F.when(F.col("c").isNotNull(), F.struct("s", "c")))
    below = prefix_scan(values, [], "s", {"below": ("max", "here")})
    both = prefix_scan(below, [], "s", {"above": ("min", "here")}, descending=True)
    sides = [F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(x)["s"] - F.col("s")).alias("d"), F.col(x)["c"].alias("c"))) for x in ("below", "above")]
    best = both.where("__t = 1").select("s", F.least(*sides).alias("best")).where(F.col("best.d") <= caliper)
    treated = rows.where("__t = 1").select(F.col("__id").alias("treated"), "s")
    return treated.join(best, "s").select("treated", F.col("best.c").alias("control"), F.col("best.d").alias("distance"))


STRIDE = 4


def _coded(points: DataFrame, axes: list[str], bits: int) -> DataFrame:
    """Add ``__code``: the position of each point as interleaved bits, one bit of every axis after the other.

    A prefix of the code names a box; a longer prefix a box inside it. The position on an axis is the share of points below, from a
    running count over the axis, written in ``bits`` bits, so boxes halve the points however the values are distributed.
    """
    coded = points
    for i, a in enumerate(axes):
        counts = points.groupBy(a).agg(F.count(F.lit(1)).alias("__n"))
        upto = prefix_scan(counts, [], a, {"__upto": ("sum", "__n")})
        total = counts.agg(F.sum("__n").alias("__total"))
        place = F.floor((F.col("__upto") - F.col("__n")) / F.lit(total.first()[0] or 1) * (1 << bits)).cast("long")
        text = F.right(F.lpad(F.bin(place), bits, "0"), F.lit(bits))
        coded = coded.join(upto.select(a, text.alias(f"__b{i}")), a)
    code = F.concat(*[F.substring(f"__b{i}", bit, 1) for bit in range(1, bits + 1) for i in range(len(axes))])
    return coded.withColumn("__code", code).drop(*[f"__b{i}" for i in range(len(axes))])


def _boxes(points: DataFrame, axes: list[str], length: int, side: str) -> DataFrame:
    """Bounding boxes and sizes of the cells at a prefix length."""
    cell = F.substring("__code", 1, length).alias(f"{side}_cell")
    bounds = [fn(a).alias(f"{side}_{a}_{tag}") for a in axes for tag, fn in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(cell).agg(F.count(F.lit(1)).alias(f"{side}_n"), *bounds)


def match_nearest(
    treated: DataFrame, control: DataFrame, id: str, cols: list[str], scale: bool = True, pairs_per_row: int = 50,
) -> DataFrame:
    """Nearest control of each treated unit in Euclidean distance over ``cols``, with replacement: (treated, control, distance).

    Exact for any distribution; ties go to the smallest control id. Identical vectors are merged first. Both sides are then split into
    ever smaller boxes; for each treated box only the control boxes that can still hold a nearest neighbour of one of its points are
    kept (smallest possible distance not above the best guaranteed one). Points are compared once the comparisons left,
    counted from box sizes, are about ``pairs_per_row`` per row.
    """
    require_columns(treated, [id, *cols])
    require_columns(control, [id, *cols])
    both = treated.select(id, F.lit(1).alias("__t"), *cols).unionByName(control.select(id, F.lit(0).alias("__t"), *cols)).na.drop(subset=cols)
    if scale:
        both = z_score(both, cols)
    axes = [f"x{i}" for i in range(len(cols))]
    points = checkpoint(both.select(F.col(id).alias("__id"), "__t", *[F.col(c).cast("double").alias(a) for c, a in zip(cols, axes)]))
    vectors = points.groupBy(*axes).agg(F.min(F.when(F.col("__t") == 0, F.col("__id"))).alias("control"), F.max("__t").alias("__t"))
    vectors = checkpoint(vectors)
    bits = max(1, vectors.count().bit_length())
    vectors = checkpoint(_coded(vectors, axes, bits))
    units, controls = vectors.where("__t = 1"), vectors.where("control IS NOT NULL")

    def gap(a):
        apart = F.greatest(F.col(f"c_{a}_lo") - F.col(f"t_{a}_hi"), F.col(f"t_{a}_lo") - F.col(f"c_{a}_hi"), F.lit(0.0))
        return apart * apart

    def reach(a):
        far = F.greatest(F.abs(F.col(f"t_{a}_hi") - F.col(f"c_{a}_lo")), F.abs(F.col(f"c_{a}_hi") - F.col(f"t_{a}_lo")))
        return far * far

    budget = pairs_per_row * vectors.count()
    length, full = 0, bits * len(axes)
    # prefixes of length 0: one box on each side, of the same (empty) name
    pairs = _boxes(units, axes, 0, "t").join(_boxes(controls, axes, 0, "c"), F.col("t_cell") == F.col("c_cell"))
    while length < full:
        before, length = length, min(length + STRIDE, full)
        t, c = _boxes(units, axes, length, "t"), _boxes(controls, axes, length, "c")
        t, c = [x.withColumn(f"{n}_up", F.substring(f"{n}_cell", 1, before)) for x, n in ((t, "t"), (c, "c"))]
        up = pairs.select(F.col("t_cell").alias("t_up"), F.col("c_cell").alias("c_up"))
        met = up.join(t, "t_up").join(c, "c_up")
        near = met.select("t_cell", "c_cell", "t_n", "c_n", sum((gap(a) for a in axes), F.lit(0.0)).alias("low"), sum((reach(a) for a in axes), F.lit(0.0)).alias("high"))
        # a box never has more candidates than survivors times 2^STRIDE; the margin covers rounding of the two sums
        near = near.withColumn("sure", F.min("high").over(Window.partitionBy("t_cell")))
        pairs = checkpoint(near.where(F.col("low") <= F.col("sure") * (1 + 1e-9)).select("t_cell", "c_cell", "t_n", "c_n"))
        if pairs.agg(F.coalesce(F.sum(F.col("t_n") * F.col("c_n")), F.lit(0))).first()[0] <= budget:
            break
    cell = F.substring("__code", 1, length)
    other = controls.select(cell.alias("c_cell"), "control", *[F.col(a).alias(f"c_{a}") for a in axes])
    compared = pairs.select("t_cell", "c_cell").join(units.select(cell.alias("t_cell"), *axes), "t_cell").join(other, "c_cell")
    square = sum(((F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in axes), F.lit(0.0))
    best = compared.groupBy(*axes).agg(F.min(F.struct(square.alias("d2"), "control")).alias("best"))
    members = points.where("__t = 1").select(F.col("__id").alias("treated"), *axes)
    return members.join(best, axes).select("treated", F.col("best.control").alias("control"), F.sqrt("best.d2").alias("distance"))


def matched_rows(pairs: DataFrame, control: DataFrame, id: str) -> DataFrame:
    """Full control rows of a match, one per treated unit, so reused controls keep their multiplicity."""
    return pairs.select("treated", F.col("control").alias(id)).join(control, id)


def balance(df: DataFrame, pairs: DataFrame, id: str, treat: str, covariates: list[str]) -> DataFrame:
    """Standardised mean difference per covariate before and after matching.

    Matched controls count as often as they were used. The spread is the pooled deviation before matching.
    """
    used = pairs.groupBy(F.col("control").alias(id)).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    kept = pairs.select(F.col("treated").alias(id)).distinct().withColumn("__k", F.lit(1.0))
    rows = df.join(used, id, "left").join(kept, id, "left").withColumn("__w", F.coalesce(F.when(F.col(treat) == 1, F.col("__k")).otherwise(F.col("__n")), F.lit(0.0)))
    long = rows.select(treat, "__w", F.inline(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in covariates])))
    arm = {k: F.col(treat) == k for k in (0, 1)}

    def mean(k, w=None):
        on = arm[k] & F.col("v").isNotNull()
        return F.avg(F.when(on, F.col("v"))) if w is None else F.sum(F.when(on, F.col("v") * w)) / F.sum(F.when(on, w))

    s = long.groupBy("covariate").agg(
        mean(1).alias("m1"), mean(0).alias("m0"), F.var_samp(F.when(arm[1], F.col("v"))).alias("v1"), F.var_samp(F.when(arm[0], F.col("v"))).alias("v0"),
        mean(1, F.col("__w")).alias("a1"), mean(0, F.col("__w")).alias("a0"),
    )
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return s.select(
        "covariate",
        F.when(sd > 0, (F.col("m1") - F.col("m0")) / sd).alias("smd_before"),
        F.when(sd > 0, (F.col("a1") - F.col("a0")) / sd).alias("smd_after"),
    )


def score_hist(df: DataFrame, treat: str, score: str, bins: int = 20, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Rows per arm and equal-width score bin (bin 0 below ``lo``, bins + 1 from ``hi`` on)."""
    return df.groupBy(treat, F.width_bucket(F.col(score), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
