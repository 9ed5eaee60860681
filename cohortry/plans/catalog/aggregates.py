"""Grouped aggregation."""

from pyspark.sql import functions as F

from cohortry.operators import aggregate as A
from cohortry.plans.catalog.shared import day, rnd
from cohortry.plans.registry import query


@query("aggregate_all_fns", """
    SELECT o_custkey, round(avg(o_totalprice)+1e-8,6) AS price_avg, round(sum(o_totalprice)+1e-4,2) AS price_sum,
      round(stddev_samp(o_totalprice)+1e-6,4) AS price_stddev, min(o_totalprice) AS price_min, max(o_totalprice) AS price_max,
      count(nullif(o_orderpriority,'5-LOW')) AS priority_count,
      round(avg((o_orderstatus='F')::int)+1e-8,6) AS done_mean, CAST(sum((o_orderstatus='F')::int) AS BIGINT) AS done_sum
    FROM orders GROUP BY 1""")
def _(t):
    o = t.orders.select(
        "o_custkey", F.col("o_totalprice").alias("price"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"), (F.col("o_orderstatus") == "F").alias("done")
    )
    r = A.aggregate(o, ["o_custkey"], {"price": ["avg", "sum", "stddev", "min", "max"], "priority": "count", "done": ["mean", "sum"]})
    return r.withColumns({
        "price_avg": rnd("price_avg"), "price_sum": rnd("price_sum", 2), "price_stddev": rnd("price_stddev", 4), "done_mean": rnd("done_mean"),
    })


@query("aggregate_median", """
    SELECT l_suppkey, round(median(l_extendedprice)+1e-6,4) AS l_extendedprice_median, median(l_quantity) AS l_quantity_median
    FROM lineitem GROUP BY 1""")
def _(t):
    r = A.aggregate(t.lineitem, ["l_suppkey"], {"l_extendedprice": "median", "l_quantity": "median"})
    return r.withColumn("l_extendedprice_median", rnd("l_extendedprice_median", 4))


@query("aggregate_median_global", "SELECT round(median(l_extendedprice)+1e-6,4) AS l_extendedprice_median, count(l_tax) AS l_tax_count FROM lineitem")
def _(t):
    r = A.aggregate(t.lineitem, [], {"l_extendedprice": "median", "l_tax": "count"})
    return r.withColumn("l_extendedprice_median", rnd("l_extendedprice_median", 4))


@query("aggregate_first_last", """
    SELECT user_id,
      arg_min_null(event_type, (ts, event_id)) AS kind_first, arg_max_null(event_type, (ts, event_id)) AS kind_last
    FROM events GROUP BY 1""".replace("arg_min_null", "min_by").replace("arg_max_null", "max_by"))
def _(t):
    e = t.events.withColumnRenamed("event_type", "kind")
    return A.aggregate(e, ["user_id"], {"kind": ["first", "last"]}, ["ts", "event_id"])


@query("aggregate_first_keeps_null", """
    SELECT o_custkey, priority AS priority_first FROM (
      SELECT o_custkey, nullif(o_orderpriority,'5-LOW') AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn = 1""")
def _(t):
    o = t.orders.withColumn("priority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return A.aggregate(o, ["o_custkey"], {"priority": "first"}, ["o_orderdate", "o_orderkey"])


@query("aggregate_ordered_list", """
    WITH d AS (SELECT DISTINCT user_id, strftime(ts,'%Y-%m-%d') AS d FROM events)
    SELECT user_id, string_agg(d, ',' ORDER BY d) AS days, string_agg(d, ';' ORDER BY d) AS d_concat_ws FROM d GROUP BY 1""")
def _(t):
    daily = t.events.select("user_id", day("ts").alias("d")).distinct()
    r = A.aggregate(daily, ["user_id"], {"d": ["collect_list", "concat_ws"]}, "d")
    return r.select("user_id", F.array_join("d_collect_list", ",").alias("days"), "d_concat_ws")


@query("aggregate_ordered_list_chunks", """
    WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) - 1 AS p FROM events)
    SELECT user_id, p // 50 AS chunk_no, string_agg(event_type, ',' ORDER BY p) AS vals FROM p GROUP BY 1, 2""")
def _(t):
    r = A.ordered_list(t.events, ["user_id"], "event_type", "ts", chunk=50)
    return r.select("user_id", "chunk_no", F.array_join("values", ",").alias("vals"))


@query("aggregate_set", """
    SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1""")
def _(t):
    r = A.aggregate(t.orders, ["o_custkey"], {"o_orderpriority": "collect_set"})
    return r.select("o_custkey", F.array_join("o_orderpriority_collect_set", ",").alias("priorities"))


@query("aggregate_person", """
    SELECT o_custkey, o_orderstatus, round(sum(o_totalprice)+1e-4,2) AS o_totalprice_sum, count(o_totalprice) AS o_totalprice_count
    FROM orders GROUP BY 1, 2""")
def _(t):
    r = A.aggregate_person(t.orders, ["o_orderstatus"], {"o_totalprice": ["sum", "count"]}, ["o_custkey"])
    return r.withColumn("o_totalprice_sum", rnd("o_totalprice_sum", 2))


@query("pivot_status", """
    SELECT o_custkey, count(*) FILTER (o_orderstatus='F') AS status_F, count(*) FILTER (o_orderstatus='O') AS status_O,
      count(*) FILTER (o_orderstatus='P') AS status_P FROM orders GROUP BY 1""")
def _(t):
    return A.pivot_count(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "status_")


@query("count_distinct_ids", """
    SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey
    FROM lineitem GROUP BY 1, 2""")
def _(t):
    return A.count_distinct_ids(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_partkey", "l_suppkey"])


@query("count_distinct", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem GROUP BY 1")
def _(t):
    return A.count_distinct(t.lineitem, ["l_partkey"], "l_suppkey")


@query("dedupe_first_by_order", """
    SELECT o_custkey, o_orderstatus, o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS first_day FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    r = A.dedupe(o, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return r.select("o_custkey", "o_orderstatus", "o_orderkey", day("o_orderdate").alias("first_day"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return A.dedupe(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("earliest_of_sources", """
    SELECT o_orderkey, strftime(min(d),'%Y-%m-%d') AS earliest FROM (
      SELECT o_orderkey, min(o_orderdate) AS d FROM orders GROUP BY 1
      UNION ALL SELECT l_orderkey, min(l_shipdate) FROM lineitem GROUP BY 1) GROUP BY 1""")
def _(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    r = A.earliest_of([(t.orders, "o_orderdate"), (lines, "l_shipdate")], ["o_orderkey"])
    return r.select("o_orderkey", day("earliest").alias("earliest"))


@query("extent", """
    SELECT strftime(min(l_shipdate),'%Y-%m-%d') AS ship_min, strftime(max(l_shipdate),'%Y-%m-%d') AS ship_max,
      min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem""")
def _(t):
    r = A.extent(t.lineitem, ["l_shipdate", "l_quantity"])
    return r.select(day("l_shipdate_min").alias("ship_min"), day("l_shipdate_max").alias("ship_max"), "l_quantity_min", "l_quantity_max")


@query("any_flag", """
    SELECT l_orderkey, max((l_returnflag='R')::int) AS returned, max((l_discount > 0.05)::int) AS discounted FROM lineitem GROUP BY 1""")
def _(t):
    lines = t.lineitem.select("l_orderkey", (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_discount") > 0.05).alias("discounted"))
    return A.any_flag(lines, ["l_orderkey"], ["returned", "discounted"])


@query("set_size", "SELECT user_id, count(DISTINCT nullif(event_type,'error')) AS kind_set_size FROM events GROUP BY 1")
def _(t):
    e = t.events.select("user_id", F.expr("nullif(event_type, 'error')").alias("kind"))
    return A.set_size(e, ["user_id"], "kind")


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return A.value_counts(t.documents, "lang")


@query("rate_by_day_kind", """
    SELECT strftime(ts,'%Y-%m-%d') AS d, event_type, count(*) AS n, CAST(sum((value > 100)::int) AS BIGINT) AS n_flag,
      round(avg((value > 100)::int)+1e-8,6) AS rate FROM events GROUP BY 1, 2""")
def _(t):
    e = t.events.select(day("ts").alias("d"), "event_type", (F.col("value") > 100).alias("high"))
    return A.rate_by(e, ["d", "event_type"], "high").withColumn("rate", rnd("rate"))


@query("describe_column", """
    SELECT count(o_totalprice) AS count, round(avg(o_totalprice)+1e-6,4) AS mean, round(stddev_samp(o_totalprice)+1e-6,4) AS stddev,
      min(o_totalprice) AS min, round(quantile_cont(o_totalprice,0.25)+1e-6,4) AS p25, round(quantile_cont(o_totalprice,0.5)+1e-6,4) AS p50,
      round(quantile_cont(o_totalprice,0.75)+1e-6,4) AS p75, max(o_totalprice) AS max FROM orders""")
def _(t):
    r = A.describe(t.orders, "o_totalprice")
    return r.withColumns({c: rnd(c, 4) for c in ("mean", "stddev", "p25", "p50", "p75")})


@query("zero_default_counts", """
    SELECT c_custkey, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    return A.count_or_zero(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_orderkey")


@query("records_per_person", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return A.row_counts(t.events, ["user_id"])
