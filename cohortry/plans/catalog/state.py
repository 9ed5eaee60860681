"""Daily facts, clinical state, chart percentiles, rule classes and levels."""

from pyspark.sql import functions as F

from cohortry.operators import concepts as K
from cohortry.operators import state as S
from cohortry.operators.quantiles import exact_quantiles
from cohortry.plans.catalog.shared import day, rnd
from cohortry.plans.registry import query
from cohortry.sources.io import inline


@query("daily_medication_facts", """
    WITH x AS (SELECT l_suppkey, coalesce(CASE WHEN l_returnflag<>'R' THEN l_shipdate END, o_orderdate) AS ts, l_quantity, p_type='PROMO' AS promo, p_type='LARGE' AS big
      FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN part ON p_partkey=l_partkey)
    SELECT l_suppkey, strftime(ts,'%Y-%m-%d') AS time_index, sum(l_quantity) AS l_quantity_sum, count(l_quantity) AS l_quantity_count, sum(promo::int)::bigint AS promo_sum FROM x WHERE promo OR big GROUP BY 1, 2""")
def _(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("given", F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")))
    ids = t.part.where("p_type IN ('PROMO', 'LARGE')").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_type") == "PROMO", "promo").otherwise("big").alias("label"))
    flagged = K.add_flags(pairs, ids, ["l_partkey"], ["promo", "big"])
    return S.daily_facts(flagged, ["l_suppkey"], ["given", "o_orderdate"], {"l_quantity": ["sum", "count"], "promo": "sum"}, labels=["promo", "big"])


@query("daily_encounter_facts", """
    SELECT o_custkey, strftime(o_orderdate,'%Y-%m-%d') AS time_index, min_by(o_orderstatus,(o_orderdate,o_orderstatus)) AS o_orderstatus_first, max_by(o_orderkey,(o_orderdate,o_orderkey)) AS o_orderkey_last, max(o_totalprice) AS o_totalprice_max FROM orders GROUP BY 1, 2""")
def _(t):
    return S.daily_facts(t.orders, ["o_custkey"], "o_orderdate", {"o_orderstatus": "first", "o_orderkey": "last", "o_totalprice": "max"})


@query("daily_diagnosis_flags", """
    SELECT l_suppkey, strftime(l_shipdate,'%Y-%m-%d') AS time_index, """ + ", ".join(f"max((p_brand='Brand#{i}')::int) AS b{i}_max" for i in range(1, 26)) + """
    FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1, 2""")
def _(t):
    """25 concept flags per record through one join, then one aggregate per day."""
    labels = [f"b{i}" for i in range(1, 26)]
    ids = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("b"), F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("label"))
    flagged = K.add_flags(t.lineitem, ids, ["l_partkey"], labels)
    r = S.daily_facts(flagged, ["l_suppkey"], "l_shipdate", {x: "max" for x in labels}, labels=labels)
    return r.select("l_suppkey", "time_index", *[F.col(f"{x}_max").cast("int").alias(f"{x}_max") for x in labels])


DEVICE = "CASE WHEN event_type='error' THEN 'ETT - Ventilator' WHEN event_type='view' THEN 'CPAP mask' WHEN event_type='click' THEN 'Nasal cannula' WHEN event_type='signup' THEN 'Room air' END"
SCORE = "CASE WHEN event_type='error' THEN 6 WHEN event_type='view' THEN 5 WHEN event_type='click' THEN 4 WHEN event_type='signup' THEN 3 END"


def _devices(t):
    k = F.col("event_type")
    text = F.when(k == "error", "ETT - Ventilator").when(k == "view", "CPAP mask").when(k == "click", "Nasal cannula").when(k == "signup", "Room air")
    return t.events.withColumn("device", text).withColumn("nominal", S.device_score(F.col("device")))


@query("device_scores", f"SELECT event_id, {DEVICE} AS device, {SCORE} AS nominal FROM events")
def _(t):
    return _devices(t).select("event_id", "device", "nominal")


@query("daily_device_facts", f"""
    SELECT user_id, strftime(ts,'%Y-%m-%d') AS time_index, max({SCORE}) AS nominal_max, string_agg(DISTINCT {DEVICE}, ';' ORDER BY {DEVICE}) AS devices FROM events GROUP BY 1, 2""")
def _(t):
    r = S.daily_facts(_devices(t), ["user_id"], "ts", {"nominal": "max", "device": "collect_set"})
    devices = F.nullif(F.array_join("device_collect_set", ";"), F.lit(""))
    return r.select("user_id", "time_index", "nominal_max", devices.alias("devices"))


@query("daily_severity", f"""
    WITH d AS (SELECT user_id, ts::date AS d, max({SCORE}) AS nominal, min(event_id) AS dev_id FROM events WHERE event_type<>'purchase' GROUP BY 1, 2),
    m AS (SELECT user_id, ts::date AS d, sum(CASE WHEN value>150 THEN 1.5 ELSE 0.0 END) AS pressor, max(CASE WHEN value>400 THEN '0' ELSE '' END) AS pump, min(event_id) AS med_id FROM events WHERE event_type='purchase' GROUP BY 1, 2),
    x AS (SELECT user_id, ts::date AS d, CASE WHEN max(value) > 480 THEN 'Expired' ELSE 'Home' END AS disp FROM events WHERE value>300 GROUP BY 1, 2),
    s AS (SELECT user_id, d FROM d UNION SELECT user_id, d FROM m UNION SELECT user_id, d FROM x)
    SELECT user_id, strftime(d,'%Y-%m-%d') AS d, coalesce(dev_id, med_id) AS enc_id, CASE WHEN disp='Expired' THEN 8 WHEN nominal=6 AND (pressor>0 OR pump<>'') THEN 7 ELSE nominal END AS score
    FROM s LEFT JOIN d USING (user_id,d) LEFT JOIN m USING (user_id,d) LEFT JOIN x USING (user_id,d)""")
def _(t):
    e = _devices(t).withColumn("d", F.to_date("ts"))
    by = ["user_id", "d"]
    devices = e.where("event_type <> 'purchase'").groupBy(*by).agg(F.max("nominal").alias("nominal"), F.min("event_id").alias("dev_id"))
    meds = e.where("event_type = 'purchase'").groupBy(*by).agg(
        F.sum(F.when(F.col("value") > 150, 1.5).otherwise(0.0)).alias("pressor"), F.max(F.when(F.col("value") > 400, "0").otherwise("")).alias("pump"), F.min("event_id").alias("med_id"))
    outs = e.where("value > 300").groupBy(*by).agg(F.when(F.max("value") > 480, "Expired").otherwise("Home").alias("disp"))
    r = S.daily_state([devices, meds, outs], by, "nominal", ["pressor", "pump"], "disp", {"enc_id": ["dev_id", "med_id"]})
    return r.select("user_id", day("d").alias("d"), "enc_id", "score")


PROBS = [5, 10, 25, 50, 75, 90, 95]


@query("chart_percentile", "WITH chart AS (SELECT p_type AS g, p_size AS x, " + ", ".join(f"quantile_cont(p_retailprice,{p/100}) AS q{p}" for p in PROBS) + """ FROM part GROUP BY 1, 2),
    ends AS (SELECT g, min(x) AS x0, max(x) AS x1 FROM chart GROUP BY 1),
    rows AS (SELECT l_orderkey, l_linenumber, p_type AS g, l_extendedprice/100.0+700 AS y, least(greatest(l_quantity*1.1+0.25, x0), x1) AS at, x1 FROM lineitem JOIN part ON p_partkey=l_partkey JOIN ends ON g=p_type),
    b AS (SELECT r.*, r.at - floor(r.at) AS w, """ + ", ".join(f"a.q{p} + (c.q{p}-a.q{p})*(r.at-floor(r.at)) AS v{p}" for p in PROBS) + """
      FROM rows r LEFT JOIN chart a ON a.g=r.g AND a.x=floor(r.at) LEFT JOIN chart c ON c.g=r.g AND c.x=least(floor(r.at)+1, r.x1))
    SELECT l_orderkey, l_linenumber, round(CASE WHEN v5 IS NULL THEN NULL WHEN y < v5 THEN 5.0 """ + " ".join(
    f"WHEN y < v{b} THEN {b} - ({b}-{a})*(v{b}-y)/(v{b}-v{a})" for a, b in zip(PROBS, PROBS[1:])) + " ELSE 95.0 END + 1e-6, 4) AS percentile FROM b")
def _(t):
    q = exact_quantiles(t.part, ["p_type", "p_size"], ["p_retailprice"], {f"q{p}": p / 100 for p in PROBS})
    chart = q.select(F.col("p_type").alias("g"), F.col("p_size").alias("x"), F.inline(F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.col(f"q{p}").alias("value")) for p in PROBS])))
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("p_type").alias("g"), (F.col("l_quantity") * 1.1 + 0.25).alias("x"), (F.col("l_extendedprice") / 100.0 + 700).alias("y"))
    r = S.chart_percentile(rows, "g", "x", "y", chart)
    return r.select("l_orderkey", "l_linenumber", rnd("percentile", 4).alias("percentile"))


@query("weight_units", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity*20<500 THEN l_quantity*20*28.3495 ELSE l_quantity*20 END+1e-6,4) AS grams FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", rnd(S.grams(F.col("l_quantity") * 20), 4).alias("grams"))


@query("dose_class", """
    SELECT l_orderkey, l_linenumber, CASE WHEN p_type='PROMO' AND l_returnflag='R' THEN 2 WHEN p_type='PROMO' THEN 1 WHEN p_type='LARGE' AND l_returnflag='A' THEN 1 WHEN p_type='LARGE' AND l_returnflag='N' THEN 2 WHEN p_type='LARGE' THEN 1 ELSE 0 END AS class
    FROM lineitem JOIN part ON p_partkey=l_partkey""")
def _(t):
    rules = inline(t.spark, [("PROMO", "R", 1, 2), ("PROMO", None, 5, 1), ("LARGE", "A", 2, 1), ("LARGE", "N", 3, 2), ("LARGE", None, 9, 1)], "item string, detail string, priority int, class int")
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_type", "l_returnflag")
    return S.rule_class(rows, rules, "p_type", "l_returnflag").select("l_orderkey", "l_linenumber", "class")


@query("device_level", """
    WITH x AS (SELECT l_orderkey, greatest(CASE WHEN contains(p_name,'ring') THEN 1 ELSE 0 END, CASE WHEN contains(p_name,'bolt') THEN 2 ELSE 0 END, CASE WHEN contains(p_name,'small') THEN 4 ELSE 0 END) AS lv, l_quantity>40 AS b
      FROM lineitem JOIN part ON p_partkey=l_partkey)
    SELECT l_orderkey, CASE WHEN bool_or(b) AND max(lv)=2 THEN 3 ELSE max(lv) END AS level FROM x GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return S.level_max(rows, ["l_orderkey"], "p_name", {"ring": 1, "bolt": 2, "small": 4}, " ", bump=(F.col("l_quantity") > 40, 2, 3))


@query("worst_encounter", """
    WITH lv AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 3 ELSE 2 END AS lv FROM orders),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY lv DESC, o_totalprice DESC, o_orderkey) AS rn FROM lv) WHERE rn=1), m AS (SELECT o_custkey, max(lv) AS m, count(*) AS n FROM lv GROUP BY 1)
    SELECT c_custkey, o_orderkey, coalesce(m,0) AS lv_max, coalesce(n,0) AS n_records FROM customer LEFT JOIN w ON w.o_custkey=c_custkey LEFT JOIN m ON m.o_custkey=c_custkey""")
def _(t):
    o = t.orders.withColumn("lv", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 3).otherwise(2))
    o = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "lv", "o_totalprice").withColumn("rank", F.col("lv"))
    r = S.worst_record(t.customer.select("c_custkey"), o, ["c_custkey"], [("rank", False), ("o_totalprice", False), ("o_orderkey", True)], ["lv"])
    return r.select("c_custkey", "o_orderkey", "lv_max", "n_records")


@query("outcome_tally", """
    SELECT o_orderpriority, 'low' AS outcome, count(*) FILTER (o_totalprice<88184.9) AS yes, count(*) FILTER (NOT o_totalprice<88184.9) AS no FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'very_low', count(*) FILTER (o_totalprice<52910.94), count(*) FILTER (NOT o_totalprice<52910.94) FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'lost', count(*) FILTER (o_orderstatus='P'), count(*) FILTER (o_orderstatus<>'P') FROM orders GROUP BY 1""")
def _(t):
    price = F.col("o_totalprice")
    return S.tally(t.orders, "o_orderpriority", {"low": price < 88184.9, "very_low": price < 52910.94, "lost": F.col("o_orderstatus") == "P"})
