"""Outcome statistics, profiling and distributions."""

from pyspark.sql import functions as F

from cohortry.operators import aggregate as A
from cohortry.operators import profile as P
from cohortry.operators import stats as S
from cohortry.plans.catalog.shared import rnd
from cohortry.plans.registry import query

Z = "1.959963984540054"
WILSON = f"round((p+{Z}*{Z}/(2*n))/(1+{Z}*{Z}/n) - {Z}/(1+{Z}*{Z}/n)*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))+1e-8,6) AS ci_low, round((p+{Z}*{Z}/(2*n))/(1+{Z}*{Z}/n) + {Z}/(1+{Z}*{Z}/n)*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))+1e-8,6) AS ci_high"


def _rounded(df):
    return df.withColumns({c: rnd(c) for c in ("rate", "ci_low", "ci_high")})


@query("prevalence", f"""
    WITH g AS (SELECT l_returnflag, sum((l_quantity>40)::int)::bigint AS yes, count(*) AS nn FROM lineitem GROUP BY 1), h AS (SELECT *, yes/nn::double AS p, nn::double AS n FROM g)
    SELECT l_returnflag, yes, nn-yes AS no, round(p+1e-8,6) AS rate, {WILSON} FROM h""")
def _(t):
    return _rounded(S.prevalence(t.lineitem.withColumn("bulk", F.col("l_quantity") > 40), ["l_returnflag"], "bulk"))


@query("prevalence_wald", f"""
    WITH h AS (SELECT o_orderpriority, sum((o_orderstatus='P')::int)::bigint AS yes, count(*)::double AS n, avg((o_orderstatus='P')::int) AS p FROM orders GROUP BY 1)
    SELECT o_orderpriority, yes, n::bigint-yes AS no, round(p+1e-8,6) AS rate, round(p-{Z}*sqrt(p*(1-p)/n)+1e-8,6) AS ci_low, round(p+{Z}*sqrt(p*(1-p)/n)+1e-8,6) AS ci_high FROM h""")
def _(t):
    return _rounded(S.prevalence(t.orders.withColumn("p", F.col("o_orderstatus") == "P"), ["o_orderpriority"], "p", "wald"))


OUTCOMES = "x AS (SELECT c_mktsegment AS arm, (o_orderstatus='P')::int AS pending, (o_orderpriority='1-URGENT')::int AS urgent, (o_totalprice>400000)::int AS big FROM orders JOIN customer ON c_custkey=o_custkey), l AS (SELECT arm, 'pending' AS outcome, pending AS v FROM x UNION ALL SELECT arm, 'urgent', urgent FROM x UNION ALL SELECT arm, 'big', big FROM x), g AS (SELECT outcome, arm, sum(v)::bigint AS yes, count(*) AS nn FROM l GROUP BY 1, 2), h AS (SELECT *, yes/nn::double AS p, nn::double AS n FROM g) "


def _outcomes(t):
    x = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("arm"), (F.col("o_orderstatus") == "P").alias("pending"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.col("o_totalprice") > 400000).alias("big"))
    return S.outcome_table(x, "arm", ["pending", "urgent", "big"])


@query("outcome_table", f"WITH {OUTCOMES} SELECT outcome, arm, yes, nn-yes AS no, round(p+1e-8,6) AS rate, {WILSON} FROM h")
def _(t):
    return _rounded(_outcomes(t))


@query("outcome_rows", f"WITH {OUTCOMES} SELECT outcome, arm, yes, nn-yes AS no FROM h WHERE outcome IN ('pending','big') AND arm IN ('BUILDING','MACHINERY')")
def _(t):
    return S.select_outcomes(_outcomes(t), ["pending", "big"], ["BUILDING", "MACHINERY"]).select("outcome", "arm", "yes", "no")


@query("fisher_2x2", f"""
    WITH {OUTCOMES}, t AS (SELECT a.outcome, a.arm AS arm_1, b.arm AS arm_2, a.yes AS a, a.nn-a.yes AS b, b.yes AS c, b.nn-b.yes AS d FROM g a JOIN g b ON a.outcome=b.outcome AND a.arm<b.arm),
    e AS (SELECT *, unnest(generate_series(greatest(0,a+c-(c+d)), least(a+b,a+c))) AS k FROM t),
    q AS (SELECT *, lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1) AS base FROM e),
    r AS (SELECT *, base-lgamma(k+1)-lgamma(a+b-k+1)-lgamma(a+c-k+1)-lgamma(d-a+k+1) AS lk, base-lgamma(a+1)-lgamma(b+1)-lgamma(c+1)-lgamma(d+1) AS lo FROM q)
    SELECT outcome, arm_1, arm_2, round(max(a*d/(b*c)::double)+1e-8,6) AS odds_ratio, round(sum(CASE WHEN lk<=lo+1e-7 THEN exp(lk) ELSE 0 END)+1e-7,5) AS p_value FROM r GROUP BY 1,2,3""")
def _(t):
    r = S.fisher_2x2(S.pairwise_2x2(_outcomes(t)))
    return r.select("outcome", "arm_1", "arm_2", rnd("odds_ratio").alias("odds_ratio"), rnd("p_value", 5).alias("p_value"))


@query("fisher_monte_carlo")
def _(t):
    return S.fisher_mc(t.orders, "o_orderstatus", "o_orderpriority", n=2000, seed=7)


@query("mann_whitney", """
    WITH x AS (SELECT (l_returnflag='R') AS g, round(l_extendedprice/100) AS v FROM lineitem WHERE l_returnflag IN ('R','N')), c AS (SELECT v, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM x GROUP BY 1),
    r AS (SELECT *, sum(n2) OVER (ORDER BY v) - n2/2.0 AS below FROM c), s AS (SELECT sum(n1)::double AS n1, sum(n2)::double AS n2, sum(n1*below)::double AS u, sum((n1+n2)::double**3-(n1+n2)) AS ties FROM r),
    z AS (SELECT *, (u-n1*n2/2)/sqrt(n1*n2/12*(n1+n2+1-ties/((n1+n2)*(n1+n2-1)))) AS z FROM s)
    SELECT n1, n2, u, round(z+1e-8,6) AS z FROM z""")
def _(t):
    x = t.lineitem.withColumn("v", F.round(F.col("l_extendedprice") / 100))
    r = S.mann_whitney(x, "l_returnflag", "v", "R", "N")
    return r.select(F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), "u", rnd("z").alias("z"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x},{y})+1e-8,6) AS corr FROM lineitem" for x in NUM for y in NUM if x != y) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{x}', '{x}', 1.0::DOUBLE" for x in NUM) + ")")
def _(t):
    return S.corr_matrix(t.lineitem, NUM).withColumn("corr", rnd("corr"))


@query("corr_with_target", " UNION ALL ".join(f"SELECT '{x}' AS x, 'returned' AS y, round(corr({x},(l_returnflag='R')::int)+1e-8,6) AS corr FROM lineitem" for x in NUM))
def _(t):
    x = t.lineitem.withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return S.corr_matrix(x, NUM, target="returned").withColumn("corr", rnd("corr"))


@query("corr_of_corr", "WITH " + ", ".join(f"m{i} AS (SELECT " + ", ".join((f"corr({x},{y})" if x != y else "1.0::DOUBLE") + f" AS {y}" for y in NUM) + " FROM lineitem)" for i, x in enumerate(NUM)) +
    ", m AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(NUM))) + ") " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, " + (f"round(corr({x},{y})+1e-7,5)" if x != y else "max(1.0::DOUBLE)") + " AS corr FROM m" for x in NUM for y in NUM))
def _(t):
    return S.corr_of_corr(t.lineitem, NUM).withColumn("corr", rnd("corr", 5))


@query("chi_square", " UNION ALL ".join(f"""
    SELECT '{f}' AS feature, round(sum(pow(coalesce(o,0)-r*c/n::double,2)/(r*c/n::double))+1e-6,4) AS statistic, ((count(DISTINCT v)-1)*(count(DISTINCT y)-1))::bigint AS dof
    FROM (SELECT {f} AS v, count(*) AS r FROM lineitem GROUP BY 1) a CROSS JOIN (SELECT l_returnflag AS y, count(*) AS c FROM lineitem GROUP BY 1) b CROSS JOIN (SELECT count(*) AS n FROM lineitem) t
    LEFT JOIN (SELECT {f} AS v2, l_returnflag AS y2, count(*) AS o FROM lineitem GROUP BY 1, 2) ON v2=v AND y2=y""" for f in ("l_linestatus", "l_linenumber", "l_suppkey")))
def _(t):
    r = S.chi_square(t.lineitem, ["l_linestatus", "l_linenumber", "l_suppkey"], "l_returnflag")
    return r.select("feature", rnd("statistic", 4).alias("statistic"), "dof")


@query("rate_per_category_and_period", """
    SELECT o_orderpriority, year(o_orderdate)::int AS y, count(*) AS n, sum((o_orderstatus='F')::int)::bigint AS n_flag, round(avg((o_orderstatus='F')::int)+1e-8,6) AS rate FROM orders GROUP BY 1, 2""")
def _(t):
    r = A.rate_by(t.orders.select("o_orderpriority", F.year("o_orderdate").alias("y"), (F.col("o_orderstatus") == "F").alias("f")), ["o_orderpriority", "y"], "f")
    return r.withColumn("rate", rnd("rate"))


@query("group_distributions", """
    WITH x AS (SELECT 'returned' AS g, l_extendedprice AS v FROM lineitem WHERE l_returnflag='R' UNION ALL SELECT 'all', l_extendedprice FROM lineitem)
    SELECT g AS "group", count(v) AS n, round(avg(v)+1e-6,4) AS mean, round(quantile_cont(v,0.1)+1e-6,4) AS p10, round(quantile_cont(v,0.5)+1e-6,4) AS p50, round(quantile_cont(v,0.9)+1e-6,4) AS p90 FROM x GROUP BY 1""")
def _(t):
    r = S.distribution({"returned": t.lineitem.where("l_returnflag = 'R'"), "all": t.lineitem}, "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return r.withColumns({c: rnd(c, 4) for c in ("mean", "p10", "p50", "p90")})


@query("integer_histogram", "SELECT length(text)::bigint // 100 AS size, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return S.histogram(t.documents.select(F.floor(F.length("text") / 100).alias("size")), "size")


FIELD = "SELECT row_number() OVER (ORDER BY {f}, i) AS row_id, '{t}' AS table_name, '{f}' AS field_name, {f}::varchar AS field_value, '' AS secondary_field_name, '' AS secondary_field_value, i AS instance, n AS value_count FROM (SELECT {f}, {i} AS i, count(*) AS n FROM {t} GROUP BY 1, 2)"


@query("field_values", "SELECT * FROM (" + " UNION ALL ".join(FIELD.format(t="lineitem", f=f, i="l_linenumber") for f in ("l_returnflag", "l_partkey")) + """
    UNION ALL SELECT row_number() OVER (ORDER BY l_suppkey, l_linestatus, i), 'lineitem', 'l_suppkey', l_suppkey::varchar, 'l_linestatus', l_linestatus, i, n FROM (SELECT l_suppkey, l_linestatus, l_linenumber AS i, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    UNION ALL SELECT row_number() OVER (ORDER BY p_name), 'part', 'p_name', p_name, '', '', NULL, n FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1))""")
def _(t):
    lines = t.lineitem.withColumnRenamed("l_linenumber", "instance")
    return P.field_values({"lineitem": (lines, ["l_returnflag", "l_partkey", ("l_suppkey", "l_linestatus")]), "part": (t.part, ["p_name"])}, instance="instance")


def _profile_sql(table, cols, inst=None, skip=()):
    parts = []
    for c, spark_type in cols.items():
        both = f"count(DISTINCT ({inst}, {c})) FILTER ({c} IS NOT NULL)" if inst else "NULL::BIGINT"
        parts.append(f"SELECT '{table}' AS table_name, count(*) AS records_cnt, '{c}' AS field_name, '{spark_type}' AS data_type, count(DISTINCT {c}) AS unique_cnt, {both} AS instance_unique_cnt, (count(*)-count({c}))::bigint AS null_cnt FROM {table}")
    return " UNION ALL ".join(parts)


ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
EVENTS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query("table_profile", _profile_sql("orders", ORDERS, "o_orderstatus") + " UNION ALL " + _profile_sql("documents", DOCUMENTS, "lang") + " UNION ALL " + _profile_sql("events", EVENTS))
def _(t):
    return P.table_profile(t.orders, "orders", "o_orderstatus").unionByName(P.table_profile(t.documents, "documents", "lang")).unionByName(P.table_profile(t.events, "events"))


@query("table_profile_sketch")
def _(t):
    return P.table_profile(t.lineitem, "lineitem", "l_linestatus", approx=True)
