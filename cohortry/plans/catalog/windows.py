"""Calendar and index-relative windows, ledgers and numbering."""

from pyspark.sql import functions as F

from cohortry.operators import timewin as W
from cohortry.plans.catalog.shared import day, rnd
from cohortry.plans.registry import query

BUCKETS = {
    "year": "year(ts)::int",
    "month": "strftime(ts,'%Y-%m')",
    "day": "strftime(ts,'%Y-%m-%d')",
    "12hour": "strftime(ts,'%Y-%m-%d-') || lpad((hour(ts)//12)::varchar,2,'0')",
    "6hour": "strftime(ts,'%Y-%m-%d-') || lpad((hour(ts)//6)::varchar,2,'0')",
    "hour": "strftime(ts,'%Y-%m-%d-%H')",
}


def _register_calendar(unit: str, expr: str) -> None:
    @query(f"tw_{unit}", f"""
        SELECT user_id, {expr} AS time_index, count(event_type) AS event_type_count, round(sum(value)+1e-4,2) AS value_sum,
          min_by(event_type, (ts, event_type)) AS event_type_first FROM events GROUP BY 1, 2""")
    def _(t):
        r = W.aggregate_regular(t.events, ["user_id"], {"event_type": ["count", "first"], "value": "sum"}, "ts", unit)
        return r.withColumn("value_sum", rnd("value_sum", 2))


for _unit, _expr in BUCKETS.items():
    _register_calendar(_unit, _expr)

FIRST_ORDERS = "WITH f AS (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS ref FROM orders), b AS (SELECT *, date_diff('day', ref::date, o_orderdate::date) AS dd FROM f), w AS (SELECT *, (dd>=1)::int + (dd>=180)::int + (dd>=720)::int AS time_index FROM b)"


def _indexed_orders(t):
    return W.group_max(t.orders.withColumn("neg", -F.unix_date(F.to_date("o_orderdate"))), ["o_custkey"], "neg", "neg_max").withColumn(
        "ref", F.date_from_unix_date(-F.col("neg_max"))
    )


@query("tw_custom_long", FIRST_ORDERS + """
    SELECT o_custkey, time_index, CASE time_index WHEN 0 THEN 'index' WHEN 1 THEN 'half_year' WHEN 2 THEN 'two_years' ELSE '3' END AS time_index_label,
      round(sum(o_totalprice)+1e-4,2) AS o_totalprice_sum, count(o_totalprice) AS o_totalprice_count FROM w GROUP BY 1, 2""")
def _(t):
    r = W.aggregate_custom(
        _indexed_orders(t), ["o_custkey"], {"o_totalprice": ["sum", "count"]}, "o_orderdate", "ref", [1, 180, 720],
        labels=["index", "half_year", "two_years"], layout="long",
    )
    return r.withColumn("o_totalprice_sum", rnd("o_totalprice_sum", 2))


@query("tw_custom_wide", FIRST_ORDERS + """
    SELECT o_custkey, count(o_totalprice) FILTER (time_index=0) AS n0, nullif(count(o_totalprice) FILTER (time_index=1),0) AS n1,
      nullif(count(o_totalprice) FILTER (time_index=2),0) AS n2, max(o_totalprice) FILTER (time_index=3) AS max3 FROM w GROUP BY 1""")
def _(t):
    r = W.aggregate_custom(_indexed_orders(t), ["o_custkey"], {"o_totalprice": ["count", "max"]}, "o_orderdate", "ref", [1, 180, 720], layout="auto")
    return r.select(
        "o_custkey", F.col("o_totalprice_count_0").alias("n0"), F.col("o_totalprice_count_1").alias("n1"),
        F.col("o_totalprice_count_2").alias("n2"), F.col("o_totalprice_max_3").alias("max3"),
    )


@query("tw_month_auto_layout", """
    SELECT user_id, round(sum(value)+1e-4,2) AS m01 FROM events WHERE strftime(ts,'%Y-%m')='2024-01' GROUP BY 1""")
def _(t):
    placed = W.add_window(t.events, "ts", "month", "month")
    r = W.aggregate_by_window(placed, ["user_id"], "month", {"value": "sum"}, layout="auto")
    return r.select("user_id", rnd("value_sum_2024-01", 2).alias("m01"))


@query("day_offset_pivot", """
    WITH f AS (SELECT user_id, event_type, date_diff('day', min(ts::date) OVER (PARTITION BY user_id), ts::date) AS d FROM events)
    SELECT user_id, """ + ", ".join(f"count(DISTINCT event_type) FILTER (d={d}) AS day_{d}" for d in range(15)) + " FROM f GROUP BY 1")
def _(t):
    firsts = t.events.groupBy("user_id").agg(F.min("ts").alias("ref"))
    return W.day_offset_pivot(t.events.join(firsts, "user_id"), ["user_id"], "ts", "ref", "event_type", 14)


@query("ledger_entries", """
    WITH d AS (SELECT user_id, ts::date AS d, min(event_type) AS k, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS ks FROM events GROUP BY 1, 2)
    SELECT user_id, strftime(min(d),'%Y-%m-%d') AS first_day, min_by(k,d) AS first_kind, strftime(max(d),'%Y-%m-%d') AS last_day, max_by(k,d) AS last_kind,
      string_agg(strftime(d,'%Y-%m-%d')||'='||ks, ',' ORDER BY d) AS entries FROM d GROUP BY 1""")
def _(t):
    r = W.ledger(t.events, ["user_id"], "ts", "event_type")
    text = F.transform("entries", lambda e: F.concat(day(e["date"]), F.lit("="), F.array_join(e["labels"], "+")))
    return r.select(
        "user_id", day("first_date").alias("first_day"), F.col("first_label").alias("first_kind"), day("last_date").alias("last_day"),
        F.col("last_label").alias("last_kind"), F.array_join(text, ",").alias("entries"),
    )


@query("group_max_on_rows", """
    SELECT l_orderkey, l_linenumber, max((l_returnflag='R')::int) OVER (PARTITION BY l_orderkey) AS outcome FROM lineitem""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("hit"))
    return W.group_max(lines, ["l_orderkey"], "hit", "outcome").drop("hit")


@query("latest_record", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1""")
def _(t):
    return W.latest(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts").drop("ts")


@query("numbered_values", """
    SELECT l_returnflag, l_partkey, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS row_id
    FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def _(t):
    counts = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return W.numbered(counts, ["l_returnflag"], "l_partkey")
