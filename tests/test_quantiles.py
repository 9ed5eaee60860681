"""Bracketed quantiles against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators.quantiles import bracket_counts, exact_quantiles

PROBS = {"least": 0.0, "p1": 0.01, "p25": 0.25, "mid": 0.5, "p99": 0.99, "most": 1.0}


def direct(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for k, n in (("hot", 30_000), ("ties", 9000), ("steps", 5000), (None, 400), ("one", 1), ("two", 2), ("empty", 3)):
        for _ in range(n):
            v = {"ties": rng.choice([1.0, 1.0, 1.0, 5.0, 7.5]), "steps": float(rng.randrange(200)), "empty": None}.get(k, rng.lognormvariate(0, 3))
            out.append((k, v if rng.random() > 0.02 or k in ("one", "two") else None, rng.randrange(-50, 50)))
    return out


@pytest.mark.parametrize("small, accuracy", [(10_000, 10_000), (500, 2000), (3000, 300)])
def test_groups(spark, rows, small, accuracy):
    df = spark.createDataFrame(rows, "k string, v double, w int").repartition(6)
    got = {(r["k"], r["column"]): r for r in exact_quantiles(df, ["k"], ["v", "w"], PROBS, small, accuracy).collect()}
    want = {}
    for k, v, w in rows:
        want.setdefault((k, "w"), []).append(w)
        if v is not None:
            want.setdefault((k, "v"), []).append(v)
    assert set(got) == set(want)
    for key, values in want.items():
        for name, p in PROBS.items():
            assert got[key][name] == pytest.approx(direct(values, p), rel=1e-12), (key, name)


def test_whole_table(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double, w int")
    r = exact_quantiles(df, [], ["v"], PROBS, small=100, accuracy=1000).first()
    assert [r[n] for n in PROBS] == [pytest.approx(direct([v for _, v, _ in rows if v is not None], p), rel=1e-12) for p in PROBS.values()]
    assert exact_quantiles(df.limit(0), [], ["v"], PROBS).count() == 0


def test_only_the_bracket_is_ranked(spark):
    df = spark.range(200_000).select(F.rand(3).alias("v"))
    assert bracket_counts(df, [], ["v"], [0.5, 0.9]).count() < 2 * 0.001 * 200_000


def test_values_of_a_group_are_not_shuffled_to_its_sketch(spark):
    """The sketches are written first, so their size is known and they are broadcast when few."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    plan = bracket_counts(df, ["g"], ["v"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
