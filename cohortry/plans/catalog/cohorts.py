"""Cohort builders on the test tables."""

from pyspark.sql import functions as F

from cohortry.functions.clinical import stage
from cohortry.operators import cohorts as C
from cohortry.operators import timewin as W
from cohortry.plans.catalog.shared import day
from cohortry.plans.catalog.temporal import FACTS, cohort, facts
from cohortry.plans.registry import query


@query("delivery_self_join", """
    WITH x AS (SELECT o_orderkey, l_linenumber, o_custkey, l_shipdate::date AS d, o_orderdate::date AS due, 280+date_diff('day',o_orderdate::date,l_shipdate::date) AS g FROM lineitem JOIN orders ON o_orderkey=l_orderkey)
    SELECT o_custkey AS person, 'o'||o_orderkey AS episode_id, 'l'||o_orderkey||'-'||l_linenumber AS child_episode_id, g::int AS gestational_days,
      CASE WHEN g>=259 THEN 'term' WHEN g>=238 THEN 'late_preterm' WHEN g>=224 THEN 'moderate_preterm' WHEN g>=196 THEN 'very_preterm' ELSE 'extremely_preterm' END AS gestation_category,
      strftime(due-280,'%Y-%m-%d') AS start_date FROM x""")
def _(t):
    parents = t.orders.select(F.col("o_custkey").alias("person"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("date").alias("delivery"), F.to_date("o_orderdate").alias("due"))
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    kids = pairs.select(F.col("o_custkey").alias("person"), F.concat(F.lit("l"), F.concat_ws("-", "o_orderkey", "l_linenumber")).alias("id"), F.concat(F.lit("o"), "o_orderkey").alias("up"), F.to_date("l_shipdate").alias("delivery"), F.lit(None).cast("date").alias("due"))
    r = C.parent_child_cohort(parents.union(kids), ["person"], "id", "up", "delivery", "due")
    return r.select("person", "episode_id", "child_episode_id", "gestational_days", "gestation_category", day("start_date").alias("start_date"))


@query("tested_cohort", """
    SELECT user_id, CASE WHEN bool_or(event_type='error') THEN '>= 1 positive' WHEN bool_or(event_type='signup') THEN '>= 1 negative (no positive)' ELSE 'inconclusive or unknown' END AS result_category,
      count(*) AS n_tests, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_test, strftime(min(ts) FILTER (event_type='error'),'%Y-%m-%d %H:%M:%S') AS first_positive FROM events GROUP BY 1""")
def _(t):
    r = C.tested_cohort(t.events, ["user_id"], "ts", "event_type", [(["error"], "positive"), (["signup"], "negative")])
    return r.select("user_id", "result_category", "n_tests", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_test", "first_positive")])


@query("eligible_pairs", """
    SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderstatus='F' AND c_acctbal>=1000 AND o_totalprice BETWEEN 10000 AND 400000""")
def _(t):
    c = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    return C.eligible_join(t.orders, c, ["o_custkey"], ["o_orderstatus = 'F'", "c_acctbal >= 1000", "o_totalprice BETWEEN 10000 AND 400000"]).select("o_orderkey", "c_mktsegment")


@query("first_index_event", "WITH " + FACTS + """
    SELECT k, strftime(min(t),'%Y-%m-%d') AS index_date, date_diff('day',i,min(t))::int AS index_day FROM c JOIN f ON f.p=c.p AND f.flag='R' AND t BETWEEN i AND i+270
    WHERE i+280 < DATE '2001-06-01' GROUP BY k, i""")
def _(t):
    c = cohort(t).withColumn("until", F.date_add("i", 270))
    r = C.index_event(c, facts(t), ["p"], "t", F.col("flag") == "R", "i", "until", cutoff="2001-06-01")
    return r.select("k", day("index_date").alias("index_date"), "index_day")


@query("index_stage_counts", "WITH " + FACTS + """
    , x AS (SELECT k, date_diff('day',i,min(t)) AS d FROM c JOIN f ON f.p=c.p AND f.flag='R' AND t BETWEEN i AND i+280 GROUP BY k, i)
    SELECT CASE WHEN d<=90 THEN '1st trimester' WHEN d<=181 THEN '2nd trimester' ELSE '3rd trimester' END AS stage, count(*) AS n FROM x GROUP BY 1""")
def _(t):
    c = cohort(t).withColumn("until", F.date_add("i", 280))
    r = C.index_event(c, facts(t), ["p"], "t", F.col("flag") == "R", "i", "until")
    return C.split_counts(r.withColumn("stage", stage(F.col("index_day"))), "stage")


@query("prior_event", "WITH " + FACTS + """
    SELECT k, max((t IS NOT NULL)::int) AS prior, strftime(min(t),'%Y-%m-%d') AS prior_date FROM c LEFT JOIN (SELECT * FROM f WHERE flag='R' AND qty>40) f ON f.p=c.p AND t<i GROUP BY 1""")
def _(t):
    r = C.prior_event(cohort(t), facts(t), ["p"], "t", (F.col("flag") == "R") & (F.col("qty") > 40), "i")
    return r.select("k", "prior", day("prior_date").alias("prior_date"))


@query("event_after_end", "WITH " + FACTS + "SELECT DISTINCT k FROM c JOIN f ON f.p=c.p AND t BETWEEN i+1 AND i+42")
def _(t):
    return C.event_after_end(cohort(t), facts(t), ["p"], "t", "i", 42).select("k")


# Dose ledger: an order is a dose, its priority the product.
DOSES = "WITH d AS (SELECT o_custkey AS p, o_orderdate::date AS d, min(o_orderpriority) AS k FROM orders WHERE o_orderstatus<>'P' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d) AS rn FROM d), " \
    "l AS (SELECT p, max(d) FILTER (rn=1) AS d1, max(k) FILTER (rn=1) AS k1, max(d) FILTER (rn=2) AS d2, max(k) FILTER (rn=2) AS k2, max(d) FILTER (rn=3) AS d3, arg_max(k,rn) AS kl FROM r GROUP BY 1), c AS (SELECT c_custkey AS p, DATE '1998-01-01' + (c_nationkey*20) AS anchor FROM customer), " \
    "q AS (SELECT l.*, k1 LIKE '1-%' AND (kl=k1 OR coalesce(d2>anchor,false)) AS one FROM l LEFT JOIN c USING (p)), s AS (SELECT * EXCLUDE (one), CASE WHEN one THEN 'single' WHEN k1 LIKE '%-%I%' AND k2 LIKE '%-%I%' THEN 'pair' END AS product, CASE WHEN one THEN d1+14 WHEN k1 LIKE '%-%I%' AND k2 LIKE '%-%I%' THEN d2+14 END AS done FROM q) "
RULES = [("single", "1-%", 1), ("pair", "%-%I%", 2)]


def _ledger(t):
    o = t.orders.where("o_orderstatus <> 'P'").withColumnRenamed("o_custkey", "p")
    return W.ledger(o, ["p"], "o_orderdate", "o_orderpriority")


def _anchored(t):
    return t.customer.select(F.col("c_custkey").alias("p"), F.date_add(F.lit("1998-01-01").cast("date"), F.col("c_nationkey") * 20).alias("anchor"))


def _series(t):
    return C.series_complete(_ledger(t).join(_anchored(t), "p", "left"), RULES, until="anchor")


@query("series_completion", DOSES + "SELECT p, product, strftime(done,'%Y-%m-%d') AS complete_date FROM s")
def _(t):
    return _series(t).select("p", "product", day("complete_date").alias("complete_date"))


@query("breakthrough", DOSES + "SELECT p, product FROM c JOIN s USING (p) WHERE done + 14 < anchor")
def _(t):
    return C.breakthrough(_anchored(t), _series(t).drop("anchor"), ["p"], "anchor", 14).select("p", "product")


@query("not_yet_dosed", DOSES + "SELECT p FROM c LEFT JOIN l USING (p) WHERE d1 IS NULL OR d1 > anchor")
def _(t):
    return C.not_yet(_anchored(t), _ledger(t), ["p"], "anchor").select("p")


@query("booster", DOSES + """
    , b AS (SELECT p, d3, date_diff('day',d2,d3) AS gap, coalesce(d3 < anchor, false) AS ok, d2 + 14 + 168 < d3 AS late FROM c LEFT JOIN l USING (p))
    SELECT p, ok::int AS boosted, strftime(CASE WHEN ok THEN d3 END,'%Y-%m-%d') AS booster_date, CASE WHEN ok THEN gap END::int AS booster_gap, (ok AND late)::int AS booster_late FROM b""")
def _(t):
    r = C.boosters(_anchored(t), _ledger(t), ["p"], "anchor")
    return r.select("p", "boosted", day("booster_date").alias("booster_date"), "booster_gap", "booster_late")


@query("status_maintained", DOSES + "SELECT p FROM c WHERE EXISTS (SELECT 1 FROM d WHERE d.p=c.p AND d.d < anchor AND anchor < d.d + INTERVAL 6 MONTH)")
def _(t):
    return C.maintained(_anchored(t), _ledger(t), ["p"], "anchor", 6).select("p")


@query("era_counts", """
    SELECT CASE WHEN o_orderdate < DATE '1996-01-01' THEN NULL WHEN o_orderdate < DATE '1998-07-03' THEN 'first' WHEN o_orderdate < DATE '2000-12-25' THEN 'second' END AS era,
      count(*) AS n, sum((o_orderstatus='P')::int)::bigint AS n_flag FROM orders GROUP BY 1""")
def _(t):
    periods = [("first", "1996-01-01", "1998-07-03"), ("second", "1998-07-03", "2000-12-25")]
    return C.era_counts(t.orders.withColumn("dead", F.col("o_orderstatus") == "P"), "o_orderdate", periods, "dead")


@query("payor_priority", """
    WITH x AS (SELECT o_custkey AS p, nullif(lower(p_name),'x') AS payor, CASE WHEN l_returnflag='R' THEN NULL ELSE p_name END AS pay, p_type AS cls FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey),
    n AS (SELECT p, CASE WHEN pay IS NULL THEN CASE WHEN cls IN ('ECONOMY','SMALL') THEN 'Other' ELSE cls END WHEN contains(pay,'ring') THEN 'Medicare' WHEN contains(pay,'bolt') OR contains(pay,'gear') THEN 'Medicaid' ELSE 'Commercial' END AS named FROM x),
    g AS (SELECT p, CASE named WHEN 'Medicaid' THEN 0 WHEN 'PROMO' THEN 0 WHEN 'Medicare' THEN 1 WHEN 'Commercial' THEN 2 WHEN 'Other' THEN 3 END AS rank FROM n)
    SELECT p, CASE min(rank) WHEN 0 THEN 'Medicaid' WHEN 1 THEN 'Medicare' WHEN 2 THEN 'Commercial' ELSE 'Other' END AS insurance FROM g WHERE rank IS NOT NULL GROUP BY 1""")
def _(t):
    chain = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    chain = chain.select(F.col("o_custkey").alias("p"), F.when(F.col("l_returnflag") != "R", F.col("p_name")).alias("payor"), F.col("p_type").alias("cls"))
    return C.payor(
        chain, ["p"], "payor", "cls", [(["ring"], "Medicare"), (["bolt", "gear"], "Medicaid")], "Commercial",
        {"Medicaid": "Medicaid", "PROMO": "Medicaid", "Medicare": "Medicare", "Commercial": "Commercial", "Other": "Other"},
        ["Medicaid", "Medicare", "Commercial", "Other"], {"ECONOMY": "Other", "SMALL": "Other"},
    )


@query("exposure_cohort", """
    WITH g AS (SELECT o_custkey AS p, l_shipdate::date AS d, list(DISTINCT p_name) AS names, max(l_quantity>25)::int AS level, min(o_orderdate)::date AS i, list(DISTINCT l_returnflag) AS acts
      FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN part ON p_partkey=l_partkey GROUP BY 1, 2),
    h AS (SELECT * FROM g WHERE len(list_filter(names, lambda x: NOT (contains(x,'ring') OR contains(x,'bolt'))))=0 AND len(list_filter(names, lambda x: x NOT IN ('small ring','red ring')))>0
      AND len(list_filter(acts, lambda x: x NOT IN ('R')))>0 AND d >= i AND level=1)
    SELECT p, strftime(min(d),'%Y-%m-%d') AS first_day FROM h GROUP BY 1""")
def _(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    daily = pairs.groupBy(F.col("o_custkey").alias("p"), F.to_date("l_shipdate").alias("d")).agg(
        F.collect_set("p_name").alias("names"), F.collect_set("l_returnflag").alias("acts"), F.max((F.col("l_quantity") > 25).cast("int")).alias("level"), F.to_date(F.min("o_orderdate")).alias("i"))
    r = C.exposure(daily, ["p"], "d", "names", ["small ring", "red ring"], ["RING", "BOLT"], lo="i", level=("level", 1), actions="acts", not_given=["R"])
    return r.select("p", day("d").alias("first_day"))


@query("any_yes_flags", """
    SELECT c_custkey, coalesce(max((o_orderstatus='P')::int),0) AS o_orderstatus FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1""")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderstatus")
    return C.any_yes(t.customer.select("c_custkey"), o, ["c_custkey"], ["o_orderstatus"], yes="P")


@query("note_history", r"""
    WITH n AS (SELECT source, CASE lang WHEN 'en' THEN DATE '2024-01-05' WHEN 'fr' THEN DATE '2024-01-10' WHEN 'de' THEN DATE '2024-02-01' ELSE DATE '2024-01-20' END AS t,
      coalesce(nullif(regexp_extract(text,'\d{3}-\d{4}'),''), nullif(regexp_extract(text,'\d+ \w+'),''), nullif(regexp_extract(text,'\d+'),'')) AS code FROM documents),
    c AS (SELECT DISTINCT source, DATE '2024-01-01' AS lo, DATE '2024-01-20' AS hi FROM documents), b AS (SELECT source, max(code) AS code FROM c JOIN n USING (source) WHERE t BETWEEN lo AND hi GROUP BY 1)
    SELECT source, code, coalesce(nullif(regexp_extract(code,'\d'),'')::int,0) AS first_digit, coalesce(nullif(regexp_extract(code,'\d(\d)',1),'')::int,0) AS second_digit FROM c LEFT JOIN b USING (source)""")
def _(t):
    dates = {"en": "2024-01-05", "fr": "2024-01-10", "de": "2024-02-01"}
    when = F.lit("2024-01-20")
    for lang, d in dates.items():
        when = F.when(F.col("lang") == lang, d).otherwise(when)
    notes = t.documents.withColumn("t", when.cast("date"))
    c = t.documents.select("source").distinct()
    lo, hi = F.lit("2024-01-01").cast("date"), F.lit("2024-01-20").cast("date")
    digits = lambda code: {"first_digit": F.nullif(F.regexp_extract(code, r"\d", 0), F.lit("")), "second_digit": F.nullif(F.regexp_extract(code, r"\d(\d)", 1), F.lit(""))}
    return C.note_history(c, notes, ["source"], "t", "text", lo, hi, [r"\d{3}-\d{4}", r"\d+ \w+", r"\d+"], digits)


@query("attach_geography", """
    SELECT o_orderkey, n_name, nullif(n_regionkey,2) AS n_regionkey FROM orders LEFT JOIN (SELECT * FROM customer JOIN nation ON 'N'||c_nationkey='N'||n_nationkey WHERE n_regionkey<>3) ON c_custkey=o_custkey""")
def _(t):
    person = t.customer.select(F.col("c_custkey").alias("p"), "c_nationkey")
    geo = t.nation.where("n_regionkey <> 3").select(F.concat(F.lit("N"), "n_nationkey").alias("area"), F.col("n_name"), "n_regionkey")
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("p"))
    r = C.attach_geo(o, person, geo, ["p"], F.concat(F.lit("N"), "c_nationkey"), "area", sentinel=2)
    return r.select("o_orderkey", "n_name", "n_regionkey")


@query("staged_enrichment", "WITH " + FACTS + """
    SELECT k, (SELECT count(*) FROM f WHERE f.p=c.p AND flag='R') AS returned, CASE WHEN p IN (SELECT p FROM f WHERE qty=50) THEN 1 ELSE 0 END AS bulk FROM c""")
def _(t):
    f = facts(t)
    returned = f.where("flag = 'R'").groupBy("p").agg(F.count(F.lit(1)).alias("returned"))
    bulk = f.where("qty = 50").select("p").distinct().withColumn("bulk", F.lit(1))
    steps = [lambda d: d.join(returned, "p", "left"), lambda d: d.join(bulk, "p", "left"), lambda d: d.na.fill(0, ["returned", "bulk"])]
    return C.staged(cohort(t), steps, checkpoint_every=2).select("k", "returned", "bulk")
