"""Encoding, matching and balance."""

from pyspark.sql import functions as F

from cohortry.operators import features as X
from cohortry.operators import matching as M
from cohortry.plans.catalog.shared import rnd
from cohortry.plans.registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment='{s}')::int AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")
def _(t):
    return X.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS)


@query("design_matrix", """
    SELECT o_orderkey, o_custkey AS person, round((o_totalprice-min(o_totalprice) OVER ())/(max(o_totalprice) OVER ()-min(o_totalprice) OVER ())+1e-8,6) AS o_totalprice,
      (o_orderstatus='F')::int AS done, (o_orderstatus='P')::int AS pending, (o_orderpriority='1-URGENT')::int AS "o_orderpriority_1-URGENT" FROM orders""")
def _(t):
    spec = X.MatrixSpec(["o_orderkey"], ["o_custkey"], {"o_orderstatus": {"done": "F", "pending": "P"}, "o_orderpriority": ["1-URGENT"]}, ["o_totalprice"], {"person": "o_custkey"})
    return X.design_matrix(t.orders, spec).withColumn("o_totalprice", rnd("o_totalprice"))


NULLED = "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag<>'R' THEN l_extendedprice END AS price, CASE WHEN l_linestatus='F' THEN l_quantity END AS qty FROM lineitem) "


def _nulled(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("qty"))


@query("median_impute", NULLED + """
    SELECT l_orderkey, l_linenumber, round(coalesce(price,(SELECT median(price) FROM x))+1e-6,4) AS price, coalesce(qty,(SELECT median(qty) FROM x)) AS qty FROM x""")
def _(t):
    return X.impute_median(_nulled(t), ["price", "qty"]).withColumn("price", rnd("price", 4))


@query("missing_report", NULLED + """
    SELECT 'price' AS "column", count(*) AS n, count(price) AS present, round(100.0*count(price)/count(*),1)::double AS percent, round(median(price)+1e-6,4) AS median FROM x
    UNION ALL SELECT 'qty', count(*), count(qty), round(100.0*count(qty)/count(*),1)::double, round(median(qty)+1e-6,4) FROM x""")
def _(t):
    return X.missing_report(_nulled(t), ["price", "qty"]).withColumn("median", rnd("median", 4))


@query("numeric_complete", """
    SELECT p_partkey || '|' || p_brand AS row_id, TRY_CAST(split_part(p_brand,'#',2) AS DOUBLE) AS brand, nullif(p_size,1)::DOUBLE AS size FROM part WHERE nullif(p_size,1) IS NOT NULL""")
def _(t):
    p = t.part.select("p_partkey", "p_brand", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"), F.expr("nullif(p_size, 1)").alias("size"))
    return X.numeric_complete(p, ["brand", "size"], ["p_partkey", "p_brand"])


CALIPER = """WITH u AS (SELECT c_custkey AS id, (c_mktsegment='BUILDING')::int AS t, c_acctbal/1000 AS s FROM customer),
    m AS (SELECT * FROM (SELECT a.id AS treated, b.id AS control, abs(a.s-b.s) AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.s-b.s), b.id) AS rn FROM u a JOIN u b ON a.t=1 AND b.t=0 AND abs(a.s-b.s)<=0.2) WHERE rn=1) """


def _units(t):
    return t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("t"), (F.col("c_acctbal") / 1000).alias("s"))


@query("caliper_match", CALIPER + "SELECT treated, control, round(d+1e-8,6) AS distance FROM m")
def _(t):
    return M.match_caliper(_units(t), "id", "t", "s", 0.2).withColumn("distance", rnd("distance"))


@query("matched_control_rows", CALIPER + "SELECT treated, control AS id, c_mktsegment, c_nationkey FROM m JOIN customer ON c_custkey=control")
def _(t):
    pairs = M.match_caliper(_units(t), "id", "t", "s", 0.2)
    return M.matched_rows(pairs, t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey"), "id")


@query("nn_match_exact", """
    WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1),
    u AS (SELECT c_custkey AS id, c_mktsegment='BUILDING' AS t, c_acctbal AS x1, n AS x2, total AS x3 FROM customer JOIN o ON o_custkey=c_custkey),
    z AS (SELECT id, t, (x1-avg(x1) OVER ())/stddev_pop(x1) OVER () AS a, (x2-avg(x2) OVER ())/stddev_pop(x2) OVER () AS b, (x3-avg(x3) OVER ())/stddev_pop(x3) OVER () AS c FROM u)
    SELECT treated, control, round(d+1e-8,6) AS distance FROM (SELECT p.id AS treated, q.id AS control, sqrt((p.a-q.a)**2+(p.b-q.b)**2+(p.c-q.c)**2) AS d,
      row_number() OVER (PARTITION BY p.id ORDER BY (p.a-q.a)**2+(p.b-q.b)**2+(p.c-q.c)**2, q.id) AS rn FROM z p JOIN z q ON p.t AND NOT q.t) WHERE rn=1""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    u = t.customer.join(o, "c_custkey").withColumnRenamed("c_custkey", "id")
    r = M.match_nearest(u.where("c_mktsegment = 'BUILDING'"), u.where("c_mktsegment <> 'BUILDING'"), "id", ["c_acctbal", "n", "total"])
    return r.withColumn("distance", rnd("distance"))


@query("smd_balance", CALIPER + """
    , o AS (SELECT o_custkey, count(*)::double AS n FROM orders GROUP BY 1), w AS (SELECT control AS id, count(*)::double AS k FROM m GROUP BY 1),
    r AS (SELECT u.id, u.t, CASE WHEN u.t=1 THEN (u.id IN (SELECT treated FROM m))::int::double ELSE coalesce(k,0) END AS w, s, coalesce(n,0) AS n FROM u LEFT JOIN w ON w.id=u.id LEFT JOIN o ON o_custkey=u.id),
    l AS (SELECT 'balance' AS covariate, t, w, s AS v FROM r UNION ALL SELECT 'orders', t, w, n FROM r),
    g AS (SELECT covariate, avg(v) FILTER (t=1) AS m1, avg(v) FILTER (t=0) AS m0, var_samp(v) FILTER (t=1) AS v1, var_samp(v) FILTER (t=0) AS v0, sum(v*w) FILTER (t=1)/sum(w) FILTER (t=1) AS a1, sum(v*w) FILTER (t=0)/sum(w) FILTER (t=0) AS a0 FROM l GROUP BY 1)
    SELECT covariate, round((m1-m0)/sqrt((v1+v0)/2)+1e-8,6) AS smd_before, round((a1-a0)/sqrt((v1+v0)/2)+1e-8,6) AS smd_after FROM g""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("orders"))
    units = _units(t)
    pairs = M.match_caliper(units, "id", "t", "s", 0.2)
    full = units.join(o, "id", "left").na.fill(0.0, ["orders"]).withColumnRenamed("s", "balance")
    r = M.balance(full, pairs, "id", "t", ["balance", "orders"])
    return r.select("covariate", rnd("smd_before").alias("smd_before"), rnd("smd_after").alias("smd_after"))


@query("score_histogram", """
    SELECT (c_mktsegment='BUILDING')::int AS t, CASE WHEN c_acctbal<0 THEN 0 WHEN c_acctbal>=10000 THEN 21 ELSE floor(c_acctbal/500)+1 END::bigint AS bin, count(*) AS n FROM customer GROUP BY 1, 2""")
def _(t):
    return M.score_hist(_units(t), "t", "s", 20, 0.0, 10.0)


@query("propensity_fit")
def _(t):
    """Customers of one segment against the rest, scored on account balance and order history."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("total"))
    u = t.customer.join(o, "c_custkey", "left").na.fill(0.0).withColumn("t", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    scored = M.propensity(u.select("c_custkey", "t", "c_acctbal", "n", "total"), "t", ["c_acctbal", "n", "total"])
    return scored.select("c_custkey", "t", rnd("score", 4).alias("score"), rnd("logit", 4).alias("logit"))


@query("propensity_equations", "SELECT term, true AS solved FROM (VALUES (''), ('c_acctbal'), ('n'), ('total')) t(term)")
def _(t):
    """Whether the propensity model solves its weighted score equations."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    u = t.customer.join(o, "c_custkey").withColumn("t", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    r = M.propensity_equations(u, "t", ["c_acctbal", "n", "total"])
    return r.select("term", (F.abs("total") <= 1e-6 * F.col("size")).alias("solved"))


@query("propensity_sensitivity")
def _(t):
    """The same match with one covariate more: matched pairs per covariate set."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    u = t.customer.join(o, "c_custkey", "left").na.fill(0.0).withColumn("t", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    u = u.withColumn("nation", F.col("c_nationkey").cast("double"))
    parts = []
    sets = {"base": ["c_acctbal", "n"], "added": ["c_acctbal", "n", "nation"]}
    for name, model in M.propensity_models(u, "t", sets).items():
        pairs = M.match_caliper(u.select("c_custkey", "t", model.logit().alias("logit")), "c_custkey", "t", "logit", 0.2)
        parts.append(pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("control").alias("controls")).withColumn("covariates", F.lit(name)))
    return parts[0].unionByName(parts[1])
