"""Joint logistic fits against single fits of another library routine and their own score equations; Poisson draws."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortry.operators import matching as M
from cohortry.operators import models as L
from cohortry.operators.glm import fit_logits, score_sums


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        a, b = rng.gauss(50, 20), rng.expovariate(1 / 3000)
        y = int(rng.random() < 1 / (1 + np.exp(1.5 - 0.04 * a + b / 4000)))
        rows.append((i, y if i % 40 else None, a if rng.random() > 0.05 else None, b, float(rng.randrange(3))))
    return spark.createDataFrame(rows, "id int, y int, a double, b double, c double").repartition(5).cache()


def test_each_model_equals_a_fit_of_its_own(data):
    weights = [F.col("id") % 3 != i for i in range(3)] + [F.lit(1), F.when(F.col("y") == 1, 2.5).otherwise(0.5), F.lit(0)]
    masks = [["a", "b", "c"]] * 3 + [["b"], ["a", "c"], ["a"]]
    fills = [[50.0, 0.0, 0.0]] * 6
    fitted = fit_logits(data, "y", ["a", "b", "c"], [w.cast("double") for w in weights], fills, masks)
    for w, mask, model in list(zip(weights, masks, fitted))[:5]:
        rows = data.na.fill(50.0, ["a"]).where("y is not null").withColumn("w", w.cast("double")).where("w > 0")
        own = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=200, tol=1e-12).fit(VectorAssembler(inputCols=mask, outputCol="x").transform(rows))
        want = dict(zip(mask, own.coefficients.toArray()))
        assert model.intercept == pytest.approx(own.intercept, rel=1e-4, abs=1e-5)
        assert model.coefficients == [pytest.approx(want.get(f, 0.0), rel=1e-4, abs=1e-8) for f in model.features]
        sums = {r["term"]: r for r in score_sums(data, "y", model, w.cast("double")).collect()}
        assert all(abs(sums[t]["total"]) <= 1e-7 * sums[t]["size"] for t in ["", *mask])
    assert fitted[5].coefficients == [0, 0, 0]


def test_a_penalty_shrinks_and_separation_ends(data, spark):
    plain, small = (fit_logits(data, "y", ["b"], [F.lit(1)], ridge=r)[0].coefficients[0] for r in (0.0, 0.5))
    assert 0 < abs(small) < abs(plain)
    apart = spark.createDataFrame([(i, int(i > 20), float(i)) for i in range(40)], "id int, y int, x double")
    model = fit_logits(apart, "y", ["x"], [F.lit(1)])[0]
    got = {r["id"]: r["p"] for r in apart.select("id", model.probability().alias("p")).collect()}
    assert all((p > 0.5) == (i > 20) for i, p in got.items())


def test_a_missing_feature_without_fill_is_an_error(data):
    with pytest.raises(Exception, match="missing"):
        fit_logits(data, "y", ["a"], [F.lit(1)])


def test_sensitivity_models_equal_single_ones(data):
    rows = data.where("y is not null")
    both = M.propensity_models(rows, "y", {"small": ["b"], "large": ["b", "c"]})
    for name, cov in (("small", ["b"]), ("large", ["b", "c"])):
        alone = M.propensity_models(rows, "y", {"": cov})[""]
        assert dict(zip(both[name].features, both[name].coefficients)) == pytest.approx({**dict.fromkeys(both[name].features, 0.0), **dict(zip(alone.features, alone.coefficients))}, rel=1e-6)


@pytest.mark.parametrize("mean", [1.0, 0.5, 0.01])
def test_poisson_draws(spark, mean):
    n = 200_000
    unit = (F.col("id") + 0.5) / n
    got = {r["k"]: r["n"] for r in spark.range(n).select(L.poisson_draws(unit, mean).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    term, k = np.exp(-mean), 0
    while term * n > 5:
        assert abs(got[k] - term * n) <= 2
        k += 1
        term *= mean / k


def test_undersampling_by_weights(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 10 == 0).cast("int")).alias("y"))
    got = L.undersample_poisson(df, "y", "id", 9)
    sums = {r["y"]: (r["d"], r["n"]) for r in got.groupBy("y").agg(F.sum("draws").alias("d"), F.count(F.lit(1)).alias("n")).collect()}
    small = min(n for y, (_, n) in sums.items() if y is not None)
    assert all(abs(d - small) <= 4 * small**0.5 for y, (d, _) in sums.items() if y is not None) and sums[None][0] == 0
    a, b = ({r["id"]: r["draws"] for r in L.undersample_poisson(x, "y", "id", 9).collect()} for x in (df, df.repartition(7)))
    assert a == b


def test_folds_learn_from_the_other_folds_only(data):
    """A changed label moves the scores of all folds but its own."""
    changed = data.withColumn("y", F.when(F.col("id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({r["id"]: r["score"] for r in L.oof_predict(x, "id", "y", ["a", "b", "c"], k=4, balance=False).collect()} for x in (data, changed))
    folds = {r["id"]: r["f"] for r in data.select("id", L.fold(F.col("id"), 4, 457).alias("f")).collect()}
    assert all((abs(a[i] - b[i]) < 1e-12) == (folds[i] == folds[7]) for i in a)
    assert len(a) == 1200
