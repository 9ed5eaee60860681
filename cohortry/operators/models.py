"""Model fits as k-fold Spark jobs, and evaluation from per-score counts."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.probability import Z95, log10_normal_two_sided
from cohortry.operators.aggregate import require_columns
from cohortry.operators.glm import fit_logits, score_sums
from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.scan import prefix_scan, rank_rows
from cohortry.operators.timewin import group_max, latest
from cohortry.session import checkpoint


# Fits ------------------------------------------------------------------------------------------

def coefficient_table(model, features: list[str], spark: SparkSession, info: dict) -> DataFrame:
    """One row per feature with its coefficient, and the run information as columns."""
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.select("*", *[F.lit(v).alias(k) for k, v in info.items() if k != "features"])


def cohort_logit(df: DataFrame, by: list[str], order: str, features: list[str], outcome: str, weights=(0.01, 0.99), max_iter: int = 100):
    """Logistic model over one record per person: (model, info).

    The last positive record of persons ever positive, the last record of all others; classes weighted (negative, positive).
    ``info`` holds features, outcome, class counts and the area under the ROC curve of the predicted probabilities.
    """
    require_columns(df, [*by, order, *features, outcome])
    flagged = group_max(df.select(*by, order, *features, F.col(outcome).cast("int").alias(outcome)), by, outcome, "__ever")
    last = latest(flagged.where(F.col(outcome) == F.col("__ever")).drop("__ever"), by, order).na.drop(subset=features)
    data = VectorAssembler(inputCols=features, outputCol="__x").transform(last.withColumn("__w", F.when(F.col(outcome) == 1, weights[1]).otherwise(weights[0])))
    data = checkpoint(data)
    model = LogisticRegression(featuresCol="__x", labelCol=outcome, weightCol="__w", maxIter=max_iter).fit(data)
    scored = model.transform(data).select(outcome, vector_to_array("probability")[1].alias("score"))
    n = {r[outcome]: r["n"] for r in data.groupBy(outcome).agg(F.count(F.lit(1)).alias("n")).collect()}
    auc = auc_delong(scored, outcome, "score").first()["auc"]
    info = {"outcome": outcome, "positive_patient_count": n.get(1, 0), "negative_patient_count": n.get(0, 0), "auc_roc": auc, "features": features}
    return model, info


def save_model(model, info: dict, path: str) -> None:
    """Store a fitted model and its run information side by side."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(info),)], "info string").write.mode("overwrite").json(f"{path}/info")


def load_model(path: str, loader=LogisticRegressionModel):
    """(model, info, coefficient table) of a stored model."""
    spark = SparkSession.getActiveSession()
    model = loader.load(f"{path}/model")
    info = json.loads(spark.read.json(f"{path}/info", schema="info string").first()["info"])
    return model, info, coefficient_table(model, info["features"], spark, info)


def fold(key: Column, k: int, seed: int) -> Column:
    """Fold 0…k-1 from a hash of the row key, independent of partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def estimator(kind: str, label: str, **options):
    """A model by name: forest (100 regression trees) or boosting (regression), on weighted rows."""
    common = {"featuresCol": "__x", "labelCol": label, "weightCol": "__w"}
    if kind == "forest":
        return RandomForestRegressor(**common, **{"numTrees": 100, "seed": 1, **options})
    if kind == "boosting":
        return GBTRegressor(**common, **{"seed": 1, **options})
    raise ValueError(f"unknown model {kind!r}")


def poisson_draws(unit: Column, mean: float) -> Column:
    """A Poisson number with the given mean (at most 1) from a uniform number in 0…1: how often its distribution function lies below it."""
    steps, term, upto = [], math.exp(-mean), 0.0
    while term > 1e-18:
        upto += term
        steps.append(upto)
        term *= mean / len(steps)
    return sum((F.when(unit > u, 1).otherwise(0) for u in steps), F.lit(0))


def poisson_weights(id: str, label: str, sizes: dict, seed: int) -> Column:
    """How often a row is drawn when every class is drawn with replacement as often as the smallest one has rows.

    Drawing n of N rows with replacement gives each row a Poisson count of mean n / N, up to the fixed total. Counts come from a seeded hash of
    the id, so there is no ranking and no table of draws, and each row decides alone. ``sizes`` maps a class to its rows.
    """
    unit = F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    smallest, out = min(sizes.values(), default=0), F.lit(0)
    for value, n in sizes.items():
        out = F.when(F.col(label) == value, poisson_draws(unit, smallest / n)).otherwise(out)
    return out


def undersample_poisson(df: DataFrame, label: str, id: str, seed: int, name: str = "draws") -> DataFrame:
    """The rows with the number of times each is drawn; classes have as many draws as the smallest one has rows, on average. Null labels: 0."""
    sizes = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    return df.withColumn(name, poisson_weights(id, label, sizes, seed))


@dataclass(frozen=True)
class Training:
    """What all folds learn from: rows with their fold, and per fold the training weight of a row and the fills of missing features."""

    rows: DataFrame
    weights: list[Column]
    fills: list[list[float]]


def training(df: DataFrame, id: str, label: str, features: list[str], k: int, seed: int, balance: bool) -> Training:
    """Rows are written once; class sizes and medians of all training sets come from one job each."""
    require_columns(df, [id, label, *features])
    data = df.select(id, F.col(label).cast("double").alias(label), *[F.col(f).cast("double").alias(f) for f in features])
    data = checkpoint(data.withColumn("__fold", fold(F.col(id), k, seed)))
    known = data.where(F.col(label).isNotNull())
    inside = known.withColumn("__set", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("__fold"))))
    medians = {(r["__set"], r["column"]): r["m"] for r in exact_quantiles(inside, ["__set"], features, {"m": 0.5}).collect()}
    sizes: dict[int, dict] = {i: {} for i in range(k)}
    if balance:
        for r in inside.groupBy("__set", label).agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r["__set"]][r[label]] = r["n"]
    learnt = [(F.col("__fold") != i) & F.col(label).isNotNull() for i in range(k)]
    weights = [F.when(learnt[i], poisson_weights(id, label, sizes[i], seed + i) if balance else F.lit(1)).otherwise(0) for i in range(k)]
    return Training(data, weights, [[medians.get((i, f), 0.0) for f in features] for i in range(k)])


def oof_predict(df: DataFrame, id: str, label: str, features: list[str], kind: str = "logistic", k: int = 5, seed: int = 457, balance: bool = True, models: list | None = None, **options) -> DataFrame:
    """Out-of-fold scores (id, label, score): each row is predicted by the model that did not see its fold.

    ``balance`` draws every class of a training set with replacement, as often as its smallest class has rows, by Poisson counts that
    serve as weights. Missing features get the median of the training folds (0 if a feature is missing throughout); rows without a label are
    predicted but never learnt from. Fitted models are appended to ``models``. Logistic models of all folds are fitted together; they take
    ``ridge`` and ``max_iter``.
    """
    sets = training(df, id, label, features, k, seed, balance)
    data, parts = sets.rows, []
    if kind == "logistic":
        fitted = fit_logits(data, label, features, sets.weights, sets.fills, **options)
        if models is not None:
            models.extend(fitted)
        score = reduce(lambda rest, i: F.when(F.col("__fold") == i, fitted[i].probability()).otherwise(rest), range(k), F.lit(None).cast("double"))
        return data.select(id, label, score.alias("score"))
    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    for i in range(k):
        filled = assembler.transform(data.withColumn("__w", sets.weights[i].cast("double")).na.fill(dict(zip(features, sets.fills[i], strict=True)), features))
        model = estimator(kind, label, **options).fit(filled.where("__w > 0"))
        if models is not None:
            models.append(model)
        parts.append(model.transform(filled.where(F.col("__fold") == i)).select(id, label, F.col("prediction").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def oof_equations(df: DataFrame, id: str, label: str, features: list[str], k: int = 5, seed: int = 457, balance: bool = True, **options) -> DataFrame:
    """(set, term, total, size): the score equations of every fold's logistic model; totals are zero but for rounding."""
    sets = training(df, id, label, features, k, seed, balance)
    fitted = fit_logits(sets.rows, label, features, sets.weights, sets.fills, **options)
    return reduce(DataFrame.unionByName, [score_sums(sets.rows, label, m, sets.weights[i]).select(F.lit(i).alias("set"), "*") for i, m in enumerate(fitted)])


def undersample(df: DataFrame, label: str, id: str, seed: int, replacement: bool = False) -> DataFrame:
    """As many rows of every class as the smallest one has, chosen by seeded hash order; ``replacement`` draws rows with repetition.

    Without repetition a histogram of the hash tells in which of 65,536 bins a class reaches its number; only that bin is ordered.
    With it, positions within a class come from a distributed scan, so a large class is not ordered in one task.
    """
    hashed = df.select(label, id, F.xxhash64(F.col(id), F.lit(seed)).alias("__h"))
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    smallest = min(sizes.values())
    if not replacement:
        binned = hashed.withColumn("__bin", F.shiftright("__h", 48))
        upto = Window.partitionBy(label).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = binned.groupBy(label, "__bin").agg(F.count(F.lit(1)).alias("__n")).withColumn("__upto", F.sum("__n").over(upto))
        border = bins.where((F.col("__upto") >= smallest) & (F.col("__upto") - F.col("__n") < smallest))
        border = border.select(label, F.col("__bin").alias("__border"), (smallest - F.col("__upto") + F.col("__n")).alias("__need"))
        placed = binned.join(border, label)
        last = Window.partitionBy(label).orderBy("__h", id)
        chosen = placed.where("__bin < __border").select(label, id).union(
            placed.where("__bin = __border").withColumn("__pos", F.row_number().over(last)).where("__pos <= __need").select(label, id)
        )
        return df.join(chosen, [label, id], "left_semi")
    ranked = rank_rows(hashed, [label], ["__h", id], "__pos").drop("__h")
    classes = F.array(*[F.struct(F.lit(v).alias(label), F.lit(n).alias("__n")) for v, n in sizes.items()])
    draws = df.sparkSession.range(smallest).select(F.col("id").alias("__draw"), F.inline(classes))
    unit = F.pmod(F.xxhash64("__draw", F.lit(seed), F.col(label)), F.lit(2**53)) / F.lit(float(2**53))
    draws = draws.select(label, "__draw", (F.floor(unit * F.col("__n")) + 1).alias("__pos"))
    return draws.join(ranked, [label, "__pos"]).select(label, id, "__draw").join(df, [label, id]).select(*df.columns)


def mean_importance(models: list, features: list[str], spark: SparkSession) -> DataFrame:
    """Importance per feature averaged over the fold models, largest first."""
    rows = [(f, float(v)) for m in models for f, v in zip(features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def top_features(importance: DataFrame, k: int) -> list[str]:
    """Names of the k most important features (k names reach the driver)."""
    return [r["feature"] for r in importance.orderBy(F.desc("importance"), "feature").limit(k).collect()]


# Evaluation --------------------------------------------------------------------------------------

def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label)
    return df.where(F.col(score).isNotNull() & y.isin(0, 1)).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(y.cast("long")).alias("p"), F.sum(1 - y.cast("long")).alias("q")
    )


def _curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with own counts p, q, cumulative tp, fp at or above the score, and totals m, n."""
    counts = _score_counts(df, label, score)
    run = prefix_scan(counts, [], "s", {"tp": ("sum", "p"), "fp": ("sum", "q")}, descending=True)
    totals = counts.agg(F.sum("p").alias("m"), F.sum("q").alias("n"))
    return run.withColumns({x: totals.select(x).scalar() for x in ("m", "n")})


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC points, one per distinct score: (threshold, tpr, fpr)."""
    return _curve(df, label, score).select(F.col("s").alias("threshold"), (F.col("tp") / F.col("m")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))


def pr(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision–recall points, one per distinct score: (threshold, precision, recall)."""
    return _curve(df, label, score).select(F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("m")).alias("recall"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Trapezoid area under the precision–recall curve, which starts at recall 0 with precision 1."""
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("q")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / F.greatest(tp0 + fp0, F.lit(1)))
    step = F.col("p") / F.col("m") * (before + F.col("tp") / (F.col("tp") + F.col("fp"))) / 2
    return _curve(df, label, score).agg(F.sum(step).alias("pr_auc"))


def placements(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """Per distinct score: counts p, q and the placements v10 (share of negatives below) and v01 (share of positives above).

    Ties count half. With a weight column the shares are shares of weight; ``pw`` and ``qw`` are the weight sums.
    """
    y = F.col(label)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(score).isNotNull() & y.isin(0, 1)).select(F.col(score).cast("double").alias("s"), y.cast("int").alias("y"), w.alias("w"))
    counts = rows.groupBy("s").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"), F.sum(F.col("w") * F.col("y")).alias("pw"), F.sum(F.col("w") * (1 - F.col("y"))).alias("qw")
    )
    run = prefix_scan(counts, [], "s", {"cp": ("sum", "pw"), "cq": ("sum", "qw")})
    totals = counts.agg(F.sum("pw").alias("wp"), F.sum("qw").alias("wq"), F.sum("p").alias("m"), F.sum("q").alias("n"))
    checked = totals.select("wp", "wq", F.when((F.col("m") > 0) & (F.col("n") > 0), F.col("m")).otherwise(F.raise_error(F.lit("both classes are needed"))).alias("m"), "n")
    run = run.withColumns({x: checked.select(x).scalar() for x in ("wp", "wq", "m", "n")})
    v10 = (F.col("cq") - F.col("qw") / 2) / F.col("wq")
    v01 = 1 - (F.col("cp") - F.col("pw") / 2) / F.col("wp")
    return run.select("s", "p", "q", "pw", "qw", "wp", "wq", "m", "n", v10.alias("v10"), v01.alias("v01"))


def _spread(n: Column, count: str, a: str, b: str) -> Column:
    """Sample covariance of two placement columns over ``count`` copies of each row, from power sums."""
    c = F.col(count)
    return (F.sum(c * F.col(a) * F.col(b)) - F.sum(c * F.col(a)) * F.sum(c * F.col(b)) / n) / (n - 1)


def auc_delong(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with DeLong variance and 95 % interval (clipped at 1), as one row."""
    v = placements(df, label, score, weight)
    m, n = F.max("m"), F.max("n")
    s = v.agg(
        (F.sum(F.col("pw") * F.col("v10")) / F.max("wp")).alias("auc"),
        (_spread(m, "p", "v10", "v10") / m + _spread(n, "q", "v01", "v01") / n).alias("variance"),
    )
    half = Z95 * F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    return s.select("auc", "variance", F.greatest(F.col("auc") - half, F.lit(0.0)).alias("ci_low"), F.least(F.col("auc") + half, F.lit(1.0)).alias("ci_high"))


def auc_compare(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """DeLong test of two scores on the same rows: areas, z, log10 of the two-sided p value, as one row."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isin(0, 1))
    cells = both.groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q")
    )
    va = placements(both, label, a).select(F.col("s").alias("a"), F.col("v10").alias("a10"), F.col("v01").alias("a01"), "m", "n")
    vb = placements(both, label, b).select(F.col("s").alias("b"), F.col("v10").alias("b10"), F.col("v01").alias("b01"))
    m, n = F.max("m"), F.max("n")

    def cov(x, y):
        return _spread(m, "p", f"{x}10", f"{y}10") / m + _spread(n, "q", f"{x}01", f"{y}01") / n

    s = cells.join(va, "a").join(vb, "b").agg(
        (F.sum(F.col("p") * F.col("a10")) / m).alias("auc_a"), (F.sum(F.col("p") * F.col("b10")) / m).alias("auc_b"),
        (cov("a", "a") + cov("b", "b") - 2 * cov("a", "b")).alias("variance"),
    )
    s = s.withColumn("z", F.when(F.col("variance") > 0, F.abs(F.col("auc_a") - F.col("auc_b")) / F.sqrt("variance")))
    return s.withColumn("log10_p", log10_normal_two_sided(F.col("z")))


def reg_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """MAE, MSE, RMSE, R² and area under the ROC curve of a score against a 0/1 label, as one row."""
    y, f = F.col(label).cast("double"), F.col(score).cast("double")
    e = y - f
    one = df.where(y.isNotNull() & f.isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.var_pop(y)).alias("r2"),
    )
    return one.select("*", auc_delong(df, label, score).select("auc").scalar().alias("auc"))
