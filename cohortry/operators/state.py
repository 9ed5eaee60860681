"""Daily fact tables, clinical state per day, chart percentiles, rule classes and per-person levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.clinical import adjusted_score
from cohortry.functions.scalars import phrase_tier, token_max
from cohortry.operators.filters import any_concept
from cohortry.operators.joins import spine_join
from cohortry.operators.ordering import top_per_group
from cohortry.operators.scan import join_same_keys
from cohortry.operators.timewin import aggregate_regular

OUNCE_GRAMS = 28.3495

# Device phrases by support level, looked up in this order.
DEVICE_TIERS = [
    (["bag valve mask", "et tube", "ett", "manual bag ventilation", "mechanical ventilation", "o2/bag valve ventilation",
      "o2/ventilator", "transport vent", "ventilator"], 6),
    (["aerosol mask", "aerosol trach", "bipap", "bi-pap", "bubble cpap", "continuous aerosol", "cpap", "hfnc",
      "high flow nasal cannula", "high flow nc", "high-flow nasal cannula", "high frequency ventilation",
      "laryngeal mask airway", "mask-aerosol", "mask-nrb", "nasal prongs", "ncpap", "non-invasive ventilation",
      "non-invasive ventilation (i.e. bi-level)", "non-invasive ventilation (niv)", "nonrebreather mask",
      "non-rebreather mask", "nrb mask", "tracheostomy collar", "vapotherm", "venti-mask", "venturi mask"], 5),
    (["cannula", "face tent", "mask-simple", "nasal cannula", "nasal mask", "nc", "o2 via face mask", "o2 via nasal cannula",
      "o2/cannula", "o2/simple mask", "open oxygen mask", "oxygen hood", "oxygen tent", "oxymask", "partial rebreather mask",
      "simple face mask", "simple mask", "trach mask"], 4),
    (["none - ra", "none (room air)", "room air", "room air (none)"], 3),
]


def device_score(c: Column, tiers=None) -> Column:
    """Nominal support score of a device text."""
    return phrase_tier(c, tiers or DEVICE_TIERS)


def daily_facts(
    facts: DataFrame, by: list[str], ts: list[str] | str, aggs: dict, unit: str = "day", labels: list[str] | None = None,
) -> DataFrame:
    """Facts per person and day. ``ts`` may list fallbacks (administration time, else order time); ``labels``
    keeps only rows carrying one of these concepts."""
    times = [ts] if isinstance(ts, str) else list(ts)
    rows = facts if labels is None else any_concept(facts, labels)
    rows = rows.withColumn("__ts", F.coalesce(*times))
    return aggregate_regular(rows.where(F.col("__ts").isNotNull()), by, aggs, "__ts", unit)


def daily_state(
    tables: list[DataFrame], keys: list[str], nominal: str, supports: list[str], disposition: str,
    first_of: dict[str, list[str]] | None = None, name: str = "score",
) -> DataFrame:
    """Union of the day keys of all tables, each table attached once, ids coalesced, adjusted score added.

    A support column counts as given if it is a number above zero, or a text that is not empty.
    """
    out = spine_join(tables, keys)
    for target, cols in (first_of or {}).items():
        out = out.withColumn(target, F.coalesce(*cols))
    kinds = dict(out.dtypes)
    tests = [F.coalesce(F.col(c) != "" if kinds[c] == "string" else F.col(c).cast("double") > 0, F.lit(False)) for c in supports]
    return out.withColumn(name, adjusted_score(F.col(nominal), tests, F.col(disposition)))


def grams(weight: Column) -> Column:
    """Weights below 500 are ounces."""
    return F.when(weight < 500, weight * OUNCE_GRAMS).otherwise(weight)


def chart_percentile(df: DataFrame, group: str, x: str, y: str, chart: DataFrame, name: str = "percentile") -> DataFrame:
    """Percentile of ``y`` at position ``x`` on a reference chart (group, x, percentile, value).

    Reference values are interpolated between whole positions, the percentile between the two bands around ``y``.
    Positions and values outside the chart are clamped to its ends. A chart curve is one row of at most as many
    values as the chart has percentiles.
    """
    curves = chart.groupBy(group, F.col("x").cast("int").alias("__x")).agg(F.array_sort(F.collect_list(F.struct("percentile", "value"))).alias("__curve"))
    ends = chart.groupBy(group).agg(F.min("x").cast("int").alias("__x0"), F.max("x").cast("int").alias("__x1"))
    placed = join_same_keys(df, ends, [group], "left").withColumn(
        "__at", F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x).cast("double"), F.col("__x0")), F.col("__x1")))
    )
    placed = placed.withColumns({"__lo": F.floor("__at").cast("int"), "__hi": F.least(F.floor("__at").cast("int") + 1, F.col("__x1")), "__w": F.col("__at") - F.floor("__at")})
    low = curves.select(F.col(group), F.col("__x").alias("__lo"), F.col("__curve").alias("__cl"))
    high = curves.select(F.col(group), F.col("__x").alias("__hi"), F.col("__curve").alias("__ch"))
    both = placed.join(low, [group, "__lo"], "left").join(high, [group, "__hi"], "left")

    blend = F.zip_with(
        "__cl", "__ch",
        lambda a, b: F.struct(a["percentile"].alias("p"), (a["value"] + (b["value"] - a["value"]) * F.col("__w")).alias("v")),
    )
    curve = F.col("__curve")
    both = both.withColumn("__curve", blend)
    above = F.array_position(F.transform(curve, lambda e: F.col(y) < e["v"]), True)
    both = both.withColumn("__k", above.cast("int"))
    here, before = F.get(curve, F.col("__k") - 1), F.get(curve, F.col("__k") - 2)
    inside = here["p"] - (here["p"] - before["p"]) * (here["v"] - F.col(y)) / (here["v"] - before["v"])
    value = (
        F.when(F.col(y).isNull() | curve.isNull(), None)
        .when(F.col("__k") == 0, F.element_at(curve, -1)["p"])
        .when(F.col("__k") == 1, F.get(curve, F.lit(0))["p"])
        .otherwise(inside)
    )
    return both.withColumn(name, value.cast("double")).select(*df.columns, name)


def rule_class(df: DataFrame, rules: DataFrame, item: str, detail: str, name: str = "class", default: int = 0) -> DataFrame:
    """Class from a rule table (item, detail, priority, class); a null detail matches any. Lowest priority wins.

    Rules are applied once per distinct (item, detail) pair and joined back.
    """
    pairs = df.select(item, detail).distinct()
    r = rules.select(F.col("item").alias("__item"), F.col("detail").alias("__detail"), "priority", F.col("class").alias("__class"))
    met = pairs.join(r, (F.col(item) == F.col("__item")) & (F.col("__detail").isNull() | (F.col("__detail") == F.col(detail))))
    found = met.groupBy(item, detail).agg(F.min_by("__class", F.struct("priority", "__class")).alias(name))
    return join_same_keys(df, found, [item, detail], "left").withColumn(name, F.coalesce(name, F.lit(default)))


def level_max(df: DataFrame, by: list[str], tokens: str, levels: dict[str, int], delimiter: str = ";", bump: tuple[Column, int, int] | None = None, name: str = "level") -> DataFrame:
    """Highest level among the tokens of all rows of a person. ``bump`` = (condition, from, to): the level ``from``, and no other,
    becomes ``to`` where the condition ever holds on a row with tokens."""
    rows = df.withColumns({
        "__level": F.coalesce(token_max(F.col(tokens), delimiter, levels), F.lit(0)),
        "__bump": F.coalesce(bump[0], F.lit(False)) & F.col(tokens).isNotNull() if bump else F.lit(False),
    })
    best = F.max("__level")
    value = F.when(F.max("__bump") & (best == bump[1]), F.lit(bump[2])).otherwise(best) if bump else best
    return rows.groupBy(*by).agg(value.alias(name))


def worst_record(cohort: DataFrame, df: DataFrame, by: list[str], order: list[tuple[str, bool]], levels: list[str], count: str = "n_records", fill: dict | None = None) -> DataFrame:
    """Per cohort row: the person's worst record, the maximum of each level, the number of records; defaults where none."""
    worst = top_per_group(df, by, order).drop(*levels)
    maxima = df.groupBy(*by).agg(*[F.max(c).alias(f"{c}_max") for c in levels], F.count(F.lit(1)).alias(count))
    out = reduce(lambda d, t: d.join(t, by, "left"), [worst, maxima], cohort)
    return out.na.fill({**{f"{c}_max": 0 for c in levels}, count: 0, **(fill or {})})


def tally(df: DataFrame, arm: str, conditions: dict[str, Column]) -> DataFrame:
    """Rows meeting / not meeting each condition per arm, in one pass: (arm, outcome, yes, no)."""
    counts = []
    for n, c in conditions.items():
        hit = F.coalesce(c, F.lit(False))
        counts += [F.count(F.when(hit, 1)).alias(f"y_{n}"), F.count(F.when(~hit, 1)).alias(f"n_{n}")]
    rows = F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(f"y_{n}").alias("yes"), F.col(f"n_{n}").alias("no")) for n in conditions])
    return df.groupBy(arm).agg(*counts).select(arm, F.inline(rows))
