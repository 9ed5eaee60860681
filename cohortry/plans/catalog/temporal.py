"""Interval logic: orders are the cohort rows (person o_custkey, index o_orderdate), line items the dated facts."""

from pyspark.sql import functions as F

from cohortry.functions.clinical import bin_code
from cohortry.operators import aggregate as A
from cohortry.operators import temporal as T
from cohortry.plans.catalog.shared import day, rnd
from cohortry.plans.registry import query

FACTS = "f AS (SELECT o_custkey AS p, l_shipdate::date AS t, l_partkey AS item, l_returnflag AS flag, l_quantity AS qty, l_linestatus AS ls FROM lineitem JOIN orders ON o_orderkey=l_orderkey), c AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderdate::date AS i FROM orders) "


def cohort(t):
    return t.orders.select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("i"))


def facts(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return pairs.select(
        F.col("o_custkey").alias("p"), F.to_date("l_shipdate").alias("t"), F.col("l_partkey").alias("item"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"), F.col("l_linestatus").alias("ls"),
    )


@query("active_status", "WITH " + FACTS + """
    SELECT k, max((t IS NOT NULL)::int) AS active FROM c LEFT JOIN (SELECT * FROM f WHERE flag='R') f ON f.p=c.p AND i BETWEEN t AND t+280 GROUP BY 1""")
def _(t):
    return T.active_status(cohort(t), facts(t).where("flag = 'R'"), ["p"], "i", "t", 280, "active").select("k", "active")


@query("two_window_exposure", "WITH " + FACTS + """
    SELECT k, strftime(t,'%Y-%m-%d') AS t, item FROM c JOIN f ON f.p=c.p AND t BETWEEN i-14 AND i+60 AND t BETWEEN i-100 AND i+30""")
def _(t):
    i = F.col("i")
    r = T.in_windows(cohort(t), facts(t), ["p"], "t", [(F.date_sub(i, 14), F.date_add(i, 60)), (F.date_sub(i, 100), F.date_add(i, 30))])
    return r.select("k", day("t").alias("t"), "item")


@query("unexposed", "WITH " + FACTS + """
    , e AS (SELECT DISTINCT c.k, c.p FROM c JOIN f ON f.p=c.p AND t BETWEEN i-14 AND i+60 WHERE flag='R')
    SELECT k FROM c WHERE k NOT IN (SELECT k FROM e) AND p NOT IN (SELECT p FROM e)""")
def _(t):
    i = F.col("i")
    exposed = T.in_windows(cohort(t), facts(t).where("flag = 'R'"), ["p"], "t", [(F.date_sub(i, 14), F.date_add(i, 60))])
    return T.unexposed(cohort(t), exposed, ["k"], ["p"]).select("k")


STAYS = "s AS (SELECT user_id, ts::date AS d, min(ts) FILTER (event_type IN ('signup','view')) AS b, max(ts) FILTER (event_type='purchase') AS e FROM events GROUP BY 1, 2) "


def _stays(t):
    e = t.events.withColumn("d", F.to_date("ts"))
    return T.stays(e, ["user_id", "d"], "event_type", "ts", ["signup", "view"], ["purchase"])


@query("stays_from_events", "WITH " + STAYS + "SELECT user_id, strftime(d,'%Y-%m-%d') AS d, strftime(b,'%H:%M:%S') AS b, strftime(e,'%H:%M:%S') AS e FROM s")
def _(t):
    return _stays(t).select("user_id", day("d").alias("d"), F.date_format("start", "HH:mm:ss").alias("b"), F.date_format("end", "HH:mm:ss").alias("e"))


@query("stays_merged", """
    WITH s AS (SELECT user_id, min(ts) FILTER (event_type='signup') AS b, max(ts) FILTER (event_type='purchase') AS e FROM events GROUP BY 1
      UNION ALL SELECT user_id, min(ts), max(ts) FROM events WHERE event_type IN ('click','error') GROUP BY 1)
    SELECT user_id, strftime(min(b),'%Y-%m-%d %H:%M:%S') AS b, strftime(max(e),'%Y-%m-%d %H:%M:%S') AS e FROM s GROUP BY 1""")
def _(t):
    recorded = t.events.where("event_type IN ('click', 'error')").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    r = T.stays(t.events, ["user_id"], "event_type", "ts", ["signup"], ["purchase"], recorded)
    return r.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("b"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("e"))


SPANS = "v AS (SELECT o_custkey AS p, l_orderkey AS lk, l_linenumber AS ln, least(o_orderdate,l_shipdate)::date AS b, least(o_orderdate,l_shipdate)::date + (l_quantity::int) AS e FROM lineitem JOIN orders ON o_orderkey=l_orderkey), c AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderdate::date AS i FROM orders) "


def _spans(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    b = F.to_date(F.least("o_orderdate", "l_shipdate"))
    return pairs.select(F.col("o_custkey").alias("p"), F.col("l_orderkey").alias("lk"), F.col("l_linenumber").alias("ln"), b.alias("start"), F.date_add(b, F.col("l_quantity").cast("int")).alias("stop"))


@query("overlap_or_near", "WITH " + SPANS + """
    SELECT k, lk, ln, date_diff('day',i,b)::int AS start_offset, date_diff('day',i,e)::int AS end_offset FROM c JOIN v ON v.p=c.p AND ((e>i AND i>=b) OR (b>i-7 AND b<i+14))""")
def _(t):
    return T.overlap_or_near(cohort(t), _spans(t), ["p"], "i", "start", "stop").select("k", "lk", "ln", "start_offset", "end_offset")


@query("clipped_days", "WITH " + SPANS + """
    SELECT c.p, strftime(i,'%Y-%m-%d') AS i, sum(date_diff('day',greatest(b,i),e)+1)::bigint AS days, strftime(min(greatest(b,i)),'%Y-%m-%d') AS first_start, strftime(max(e),'%Y-%m-%d') AS last_stop
    FROM (SELECT DISTINCT p,i,i+CASE WHEN p%3=0 THEN -5 ELSE 120 END AS until FROM c) c JOIN v ON v.p=c.p AND e>=i AND b<until GROUP BY 1, 2""")
def _(t):
    c = cohort(t).withColumn("until", F.date_add("i", F.when(F.col("p") % 3 == 0, -5).otherwise(120)))
    r = T.clipped_days(c, _spans(t), ["p"], "i", "until")
    return r.select("p", day("i").alias("i"), "days", day("first_start").alias("first_start"), day("last_stop").alias("last_stop"))


@query("treatment_onset", """
    SELECT l_orderkey, l_linenumber, strftime(CASE WHEN l_shipdate::date < o_orderdate::date-5 THEN o_orderdate ELSE l_shipdate END,'%Y-%m-%d') AS onset FROM lineitem JOIN orders ON o_orderkey=l_orderkey""")
def _(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return pairs.select("l_orderkey", "l_linenumber", day(T.onset(F.to_date("o_orderdate"), F.to_date("l_shipdate"))).alias("onset"))


@query("window_counts", "WITH " + FACTS + """
    SELECT k, count(DISTINCT item) AS n_items, count(DISTINCT item) FILTER (ls='F') AS "n_items_F", count(DISTINCT item) FILTER (ls='O') AS "n_items_O"
    FROM c LEFT JOIN f ON f.p=c.p AND t BETWEEN i-30 AND i+90 GROUP BY 1""")
def _(t):
    i = F.col("i")
    r = T.window_item_counts(cohort(t), facts(t), ["p"], "t", F.date_sub(i, 30), F.date_add(i, 90), "item", ("ls", ["F", "O"]))
    return r.select("k", "n_items", "n_items_F", "n_items_O")


@query("window_counts_wide", "WITH " + FACTS + """
    SELECT k, count(DISTINCT item) AS n_items, count(DISTINCT item) FILTER (ls='F') AS "n_items_F", count(DISTINCT item) FILTER (ls='O') AS "n_items_O"
    FROM c LEFT JOIN f ON f.p=c.p AND t BETWEEN i-900 AND i+1200 GROUP BY 1""")
def _(t):
    i = F.col("i")
    r = T.wide_window_item_counts(cohort(t), facts(t), ["p"], "t", F.date_sub(i, 900), F.date_add(i, 1200), "item", ("ls", ["F", "O"]))
    return r.select("k", "n_items", "n_items_F", "n_items_O")


@query("window_set", "WITH " + FACTS + """
    SELECT k, count(DISTINCT item) AS items_count, string_agg(DISTINCT item::varchar, ',' ORDER BY item::varchar) AS items_list
    FROM c LEFT JOIN (SELECT * FROM f WHERE flag='R' UNION ALL SELECT * FROM f WHERE ls='F') f ON f.p=c.p AND t BETWEEN i+1 AND i+45 GROUP BY 1""")
def _(t):
    f = facts(t).withColumn("item", F.col("item").cast("string"))
    r = T.window_set(cohort(t), [f.where("flag = 'R'"), f.where("ls = 'F'")], ["p"], "t", F.date_add("i", 1), F.date_add("i", 45), "item")
    return r.select("k", "items_count", F.array_join("items_list", ",").alias("items_list"))


@query("flag_in_window", "WITH " + FACTS + """
    SELECT k, coalesce(max((flag='R')::int),0) AS prior_returned, coalesce(max((qty>45)::int),0) AS prior_bulk FROM c LEFT JOIN f ON f.p=c.p AND t BETWEEN i-365 AND i-1 GROUP BY 1""")
def _(t):
    f = facts(t).withColumns({"returned": F.col("flag") == "R", "bulk": F.col("qty") > 45})
    r = T.flag_in_window(cohort(t), [f], ["p"], "t", F.date_sub("i", 365), F.date_sub("i", 1), ["returned", "bulk"], "prior_")
    return r.select("k", "prior_returned", "prior_bulk")


@query("two_source_status", "WITH " + FACTS + """
    SELECT k, coalesce(max((s='a')::int),0) AS from_a, coalesce(max((s='b')::int),0) AS from_b FROM c LEFT JOIN
      (SELECT p,t,'a' AS s FROM f WHERE flag='A' UNION ALL SELECT p,t,'b' FROM f WHERE qty<3) u ON u.p=c.p AND t BETWEEN i AND i+30 GROUP BY 1""")
def _(t):
    a = facts(t).where("flag = 'A'").select("p", "t", F.lit(1).alias("from_a"), F.lit(0).alias("from_b"))
    b = facts(t).where("qty < 3").select("p", "t", F.lit(0).alias("from_a"), F.lit(1).alias("from_b"))
    return T.flag_in_window(cohort(t), [a, b], ["p"], "t", F.col("i"), F.date_add("i", 30), ["from_a", "from_b"]).select("k", "from_a", "from_b")


@query("event_within_months", "WITH " + FACTS + """
    SELECT k, max((t IS NOT NULL)::int) AS death, strftime(min(t),'%Y-%m-%d') AS death_date FROM c LEFT JOIN (SELECT * FROM f WHERE qty=50) f ON f.p=c.p AND t>=i AND t<=i+INTERVAL 3 MONTH GROUP BY 1""")
def _(t):
    r = T.event_after(cohort(t), facts(t).where("qty = 50"), ["p"], "i", "t", 3, name="death")
    return r.select("k", "death", day("death_date").alias("death_date"))


@query("event_before_bound_only", "WITH " + FACTS + """
    SELECT k, max((t IS NOT NULL)::int) AS death, strftime(min(t),'%Y-%m-%d') AS death_date FROM c LEFT JOIN (SELECT * FROM f WHERE qty=50) f ON f.p=c.p AND t<=i+INTERVAL 3 MONTH GROUP BY 1""")
def _(t):
    r = T.event_after(cohort(t), facts(t).where("qty = 50"), ["p"], "i", "t", 3, lower=False, name="death")
    return r.select("k", "death", day("death_date").alias("death_date"))


@query("daily_sum_to_anchor", "WITH " + FACTS + """
    SELECT k, coalesce(sum(qty),0) AS qty_sum FROM c LEFT JOIN f ON f.p=c.p AND t BETWEEN i AND i+200 GROUP BY 1""")
def _(t):
    return T.window_sum(cohort(t), facts(t), ["p"], "t", F.col("i"), F.date_add("i", 200), "qty").select("k", "qty_sum")


@query("ever_in_window", "WITH " + FACTS + """
    SELECT k, coalesce(max((ls='F')::int),0) AS ever FROM c LEFT JOIN (SELECT * FROM f WHERE flag<>'N') f ON f.p=c.p AND t BETWEEN i+1 AND i+97 GROUP BY 1""")
def _(t):
    pred = (F.col("ls") == "F") & (F.col("flag") != "N")
    return T.ever_in(cohort(t), facts(t), ["p"], "t", F.date_add("i", 1), F.date_add("i", 97), pred).select("k", "ever")


@query("exclude_if_any", "WITH " + FACTS + "SELECT k FROM c WHERE p NOT IN (SELECT p FROM f WHERE qty=50 AND flag='R')")
def _(t):
    return T.exclude_if_any(cohort(t), facts(t), ["p"], (F.col("qty") == 50) & (F.col("flag") == "R")).select("k")


@query("offset_histogram", """
    SELECT date_diff('day',o_orderdate::date,l_shipdate::date)::int AS offset_days, count(*) AS n FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1""")
def _(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return A.value_counts(T.offset_days(pairs, "o_orderdate", "l_shipdate", "offset_days"), "offset_days")


@query("exposure_profile", "WITH " + FACTS + """
    , a AS (SELECT p, min(i) AS i FROM c GROUP BY 1),
    x AS (SELECT a.p, item, qty, date_diff('day',i,t) AS dd, p_type FROM a JOIN f ON f.p=a.p AND t BETWEEN i-14 AND i+60 JOIN part ON p_partkey=item)
    SELECT a.p, coalesce(max((p_type='PROMO')::int),0) AS promo, coalesce(max((p_type IN ('LARGE','MEDIUM'))::int),0) AS sized,
      coalesce(round(sum(qty) FILTER (dd<0)+1e-4,2),0) AS qty_before, coalesce(round(sum(qty) FILTER (dd>=0 AND dd<14)+1e-4,2),0) AS qty_early,
      coalesce(round(sum(qty) FILTER (dd>=14)+1e-4,2),0) AS qty_late FROM a LEFT JOIN x ON x.p=a.p GROUP BY 1""")
def _(t):
    """Flagship: anchor = first order per customer; facts flagged by part concept, kept in −14…+60 days of the anchor,
    summed over index-relative windows, with one status column per concept."""
    from cohortry.plans.exposure import exposure_profile

    anchors = t.orders.groupBy(F.col("o_custkey").alias("p")).agg(F.min(F.to_date("o_orderdate")).alias("i"))
    kinds = t.part.select(F.col("p_partkey").alias("item"), F.when(F.col("p_type") == "PROMO", "promo").when(F.col("p_type").isin("LARGE", "MEDIUM"), "sized").alias("label"))
    r = exposure_profile(anchors, facts(t), ["p"], "i", "t", "item", "qty", kinds.where("label IS NOT NULL"), ["promo", "sized"], (-14, 60), [0, 14])
    sums = {c: F.coalesce(rnd(f"qty_sum_{i}", 2), F.lit(0.0)) for i, c in enumerate(["qty_before", "qty_early", "qty_late"])}
    return r.select("p", "promo", "sized", *[v.alias(c) for c, v in sums.items()])


@query("stage_split_counts", """
    SELECT CASE WHEN l_quantity<18 THEN 0 WHEN l_quantity<35 THEN 1 ELSE 2 END AS stage, count(*) AS n FROM lineitem WHERE l_returnflag='A' GROUP BY 1""")
def _(t):
    from cohortry.operators.cohorts import split_counts

    staged = t.lineitem.withColumn("stage", bin_code(F.col("l_quantity"), [18, 35], [0, 1, 2]))
    return split_counts(staged, "stage", "l_returnflag = 'A'")
