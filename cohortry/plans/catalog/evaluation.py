"""Model fits and evaluation of scores against labels."""

from pyspark.sql import functions as F

from cohortry.operators import aggregate as A
from cohortry.operators import models as M
from cohortry.plans.catalog.shared import rnd
from cohortry.plans.registry import query
from cohortry.sources.io import scratch_folder

# Score: length of the document in hundreds; label: its quality. Ties are frequent on purpose.
L = "x AS (SELECT l.doc_id AS id, quality AS y, floor(n_chars/100)::double AS s, length(text) - length(replace(text,' ','')) AS s2, toxic AS w FROM labels l JOIN documents d ON d.doc_id=l.doc_id), tot AS (SELECT sum(y)::double AS m, sum(1-y)::double AS n FROM x), c AS (SELECT s, sum(y)::double AS p, sum(1-y)::double AS q FROM x GROUP BY 1)"


def _scored(t):
    d = t.documents.select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("s2"))
    x = t.labels.join(d, "doc_id")
    return x.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.floor(F.col("n_chars") / 100).cast("double").alias("s"), "s2", (F.col("toxic") + 1).alias("w"))


@query("class_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def _(t):
    return A.value_counts(t.labels, "quality")


@query("roc_points", f"WITH {L} SELECT s AS threshold, round(sum(p) OVER (ORDER BY s DESC)/m+1e-8,6) AS tpr, round(sum(q) OVER (ORDER BY s DESC)/n+1e-8,6) AS fpr FROM c, tot")
def _(t):
    return M.roc(_scored(t), "y", "s").select("threshold", rnd("tpr").alias("tpr"), rnd("fpr").alias("fpr"))


@query("pr_points", f"WITH {L} SELECT s AS threshold, round(sum(p) OVER w/(sum(p+q) OVER w)+1e-8,6) AS precision, round(sum(p) OVER w/m+1e-8,6) AS recall FROM c, tot WINDOW w AS (ORDER BY s DESC)")
def _(t):
    return M.pr(_scored(t), "y", "s").select("threshold", rnd("precision").alias("precision"), rnd("recall").alias("recall"))


@query("pr_auc", f"""WITH {L}, r AS (SELECT s, sum(p) OVER w/(sum(p+q) OVER w) AS pre, sum(p) OVER w/m AS rec FROM c, tot WINDOW w AS (ORDER BY s DESC)),
    k AS (SELECT (rec-coalesce(lag(rec) OVER (ORDER BY s DESC),0))*(pre+coalesce(lag(pre) OVER (ORDER BY s DESC),1))/2 AS a FROM r) SELECT round(sum(a)+1e-8,6) AS pr_auc FROM k""")
def _(t):
    return M.pr_auc(_scored(t), "y", "s").select(rnd("pr_auc").alias("pr_auc"))


DELONG = f"""WITH {L}, pairs AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.s>b.s THEN 1.0 WHEN a.s=b.s THEN 0.5 ELSE 0.0 END AS h, CASE WHEN a.s2>b.s2 THEN 1.0 WHEN a.s2=b.s2 THEN 0.5 ELSE 0.0 END AS h2, a.w+1 AS wi, b.w+1 AS wj FROM x a JOIN x b ON a.y=1 AND b.y=0),
    v10 AS (SELECT i, avg(h)::double AS v, avg(h2)::double AS v2, sum(h*wj)/sum(wj)::double AS vw, max(wi) AS wi FROM pairs GROUP BY 1), v01 AS (SELECT j, avg(h)::double AS v, avg(h2)::double AS v2, sum(h*wi)/sum(wi)::double AS vw FROM pairs GROUP BY 1) """


@query("auc_delong", DELONG + f"""
    , r AS (SELECT (SELECT avg(v) FROM v10) AS auc, (SELECT var_samp(v)/count(*) FROM v10)+(SELECT var_samp(v)/count(*) FROM v01) AS var)
    SELECT round(auc+1e-8,6) AS auc, round(var+1e-10,8) AS variance, round(auc-{1.959963984540054}*sqrt(var)+1e-8,6) AS ci_low, round(least(auc+{1.959963984540054}*sqrt(var),1)+1e-8,6) AS ci_high FROM r""")
def _(t):
    r = M.auc_delong(_scored(t), "y", "s")
    return r.select(rnd("auc").alias("auc"), rnd("variance", 8).alias("variance"), rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


@query("auc_delong_weighted", DELONG + """
    SELECT round((SELECT sum(vw*wi)/sum(wi) FROM v10)+1e-8,6) AS auc, round((SELECT var_samp(vw)/count(*) FROM v10)+(SELECT var_samp(vw)/count(*) FROM v01)+1e-10,8) AS variance""")
def _(t):
    r = M.auc_delong(_scored(t), "y", "s", "w")
    return r.select(rnd("auc").alias("auc"), rnd("variance", 8).alias("variance"))


@query("auc_delong_paired", DELONG + """
    , r AS (SELECT (SELECT avg(v) FROM v10) AS a, (SELECT avg(v2) FROM v10) AS b, (SELECT (var_samp(v)+var_samp(v2)-2*covar_samp(v,v2))/count(*) FROM v10)+(SELECT (var_samp(v)+var_samp(v2)-2*covar_samp(v,v2))/count(*) FROM v01) AS var)
    SELECT round(a+1e-8,6) AS auc_a, round(b+1e-8,6) AS auc_b, round(abs(a-b)/sqrt(var)+1e-6,4) AS z FROM r""")
def _(t):
    r = M.auc_compare(_scored(t), "y", "s", "s2")
    return r.select(rnd("auc_a").alias("auc_a"), rnd("auc_b").alias("auc_b"), rnd("z", 4).alias("z"))


@query("reg_metrics", DELONG + """
    , k AS (SELECT y, s/(SELECT max(s) FROM x) AS f FROM x)
    SELECT round(avg(abs(y-f))+1e-8,6) AS mae, round(avg((y-f)*(y-f))+1e-8,6) AS mse, round(sqrt(avg((y-f)*(y-f)))+1e-8,6) AS rmse, round(1-avg((y-f)*(y-f))/var_pop(y)+1e-8,6) AS r2, round((SELECT avg(v) FROM v10)+1e-8,6) AS auc FROM k""")
def _(t):
    x = _scored(t)
    top = x.agg(F.max("s").alias("m")).select("m").scalar()
    r = M.reg_metrics(x.withColumn("f", F.col("s") / top), "y", "f")
    return r.select(*[rnd(c).alias(c) for c in ("mae", "mse", "rmse", "r2", "auc")])


FEATURES = ["s", "s2", "w"]


@query("oof_logistic")
def _(t):
    return M.oof_predict(_scored(t), "id", "y", FEATURES, "logistic", k=5)


@query("oof_logistic_equations", """
    SELECT s.i::int AS "set", term, true AS solved FROM range(5) s(i), (VALUES (''), ('s'), ('s2'), ('w')) t(term)""")
def _(t):
    """Whether the fitted model of every fold solves its weighted score equations."""
    r = M.oof_equations(_scored(t), "id", "y", FEATURES, k=5)
    return r.select("set", "term", (F.abs("total") <= 1e-6 * F.col("size")).alias("solved"))


@query("oof_forest")
def _(t):
    return M.oof_predict(_scored(t), "id", "y", FEATURES, "forest", k=3, maxDepth=4)


@query("oof_boosting")
def _(t):
    return M.oof_predict(_scored(t), "id", "y", FEATURES, "boosting", k=3, maxDepth=3, maxIter=10)


@query("feature_importance")
def _(t):
    models = []
    M.oof_predict(_scored(t), "id", "y", FEATURES, "forest", k=3, models=models, maxDepth=4, numTrees=20)
    return M.mean_importance(models, FEATURES, t.spark)


@query("undersample", """
    WITH s AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality)) SELECT y, n FROM (VALUES (0),(1)) v(y), s""")
def _(t):
    x = M.undersample(_scored(t), "y", "id", 457)
    return A.value_counts(x, "y")


@query("undersample_with_replacement", """
    WITH s AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality)) SELECT y, n FROM (VALUES (0),(1)) v(y), s""")
def _(t):
    return A.value_counts(M.undersample(_scored(t), "y", "id", 457, replacement=True), "y")


@query("undersample_poisson", "SELECT quality AS y, count(*) AS n, true AS near FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(t):
    """Rows of each class, and whether its draws lie within four standard errors of the smallest class."""
    x = M.undersample_poisson(_scored(t), "y", "id", 457)
    per = x.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("draws").alias("drawn"))
    least = per.agg(F.min("n").alias("m")).select("m").scalar()
    return per.select("y", "n", (F.abs(F.col("drawn") - least) <= 4 * F.sqrt(least)).alias("near"))


@query("cohort_logit_coefficients")
def _(t):
    """Logistic model over one event per user, saved, loaded again and shown as its coefficient table."""
    e = t.events.select("user_id", "ts", "value", F.hour("ts").cast("double").alias("hour"), (F.col("event_type") == "purchase").cast("int").alias("bought"))
    first = e.groupBy("user_id").agg(F.min("ts").alias("f"))
    e = e.join(first, "user_id").withColumn("bought", F.when(F.datediff("ts", "f") >= 27, F.col("bought")).otherwise(0))
    model, info = M.cohort_logit(e, ["user_id"], "ts", ["value", "hour"], "bought")
    path = scratch_folder(t.spark) + "/model"
    M.save_model(model, info, path)
    return M.load_model(path)[2]
