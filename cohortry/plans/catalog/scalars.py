"""Scalar expressions."""

from pyspark.sql import functions as F

from cohortry.functions import clinical as C
from cohortry.functions import scalars as X
from cohortry.plans.catalog.shared import day, rnd
from cohortry.plans.registry import query


@query("clean_string", r"""
    SELECT doc_id, md5(regexp_replace(lower(regexp_replace(translate(coalesce(text,''), '.*:-()', ''), '^\s+|\s+$', '', 'g')), ' +', ' ', 'g')) AS cleaned FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(X.clean_string(F.col("text"))).alias("cleaned"))


@query("zero_pad", "SELECT p_partkey, right('000' || p_partkey, 3) AS a, right('00000' || p_size, 5) AS b FROM part")
def _(t):
    return t.part.select("p_partkey", X.zero_pad_front(F.col("p_partkey")).alias("a"), X.zero_pad_front(F.col("p_size"), 5).alias("b"))


@query("zero_pad_sql_function", "SELECT l_orderkey, l_linenumber, right('0000000' || l_partkey, 7) AS padded FROM lineitem")
def _(t):
    X.register_sql(t.spark)
    t.lineitem.createOrReplaceTempView("zp_lineitem")
    return t.spark.sql("SELECT l_orderkey, l_linenumber, zero_pad_front(CAST(l_partkey AS STRING), 7) AS padded FROM zp_lineitem")


@query("split_item", "SELECT o_orderkey, split_part(o_orderpriority,'-',1) AS code, CASE WHEN contains(o_orderpriority,' ') THEN split_part(o_orderpriority,' ',2) END AS second FROM orders")
def _(t):
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", X.split_at(p, "-", 0).alias("code"), X.split_at(p, " ", 1).alias("second"))


@query("derive_key", """
    SELECT c_custkey, CASE WHEN c_mktsegment='BUILDING' THEN substring(c_name,2,length(c_name)-2) WHEN c_mktsegment='MACHINERY' THEN substring(c_name,2,4)
      ELSE substring(c_name,1,length(c_name)-1) END AS area FROM customer""")
def _(t):
    seg = F.col("c_mktsegment")
    return t.customer.select("c_custkey", X.derive_key(F.col("c_name"), [(seg == "BUILDING", 2, -2), (seg == "MACHINERY", 2, 4)], (0, -1)).alias("area"))


@query("strip_marker", "SELECT p_partkey, regexp_replace(p_name,'^s','') AS name FROM part")
def _(t):
    return t.part.select("p_partkey", X.strip_prefix(F.col("p_name"), "s").alias("name"))


@query("regex_cascade", r"""
    WITH m AS (SELECT doc_id, coalesce(nullif(regexp_extract(text,'\d{3}-\d{4}'),''), nullif(regexp_extract(text,'[A-Za-z]+\d+'),''), nullif(regexp_extract(text,'\d+ \w+'),''), nullif(regexp_extract(text,'\d+'),'')) AS hit FROM documents)
    SELECT doc_id, hit, nullif(regexp_extract(hit,'\d'),'') AS digit FROM m""")
def _(t):
    d = t.documents.select("doc_id", X.regex_first(F.col("text"), [r"\d{3}-\d{4}", r"[A-Za-z]+\d+", r"\d+ \w+", r"\d+"]).alias("hit"))
    return d.withColumn("digit", X.regex_first(F.col("hit"), [r"\d"]))


@query("coalesce_first", """
    SELECT o_orderkey, split_part(coalesce(nullif(o_orderpriority,'5-LOW'), o_orderstatus || '-' || o_custkey),'-',1) AS ref FROM orders""")
def _(t):
    a, b = F.expr("nullif(o_orderpriority, '5-LOW')"), F.concat_ws("-", "o_orderstatus", "o_custkey")
    return t.orders.select("o_orderkey", X.coalesce_first([a, b], "-").alias("ref"))


@query("phrase_tiers", """
    SELECT p_partkey, CASE WHEN contains(lower(p_name),'ring') OR contains(lower(p_name),'bolt') THEN 6 WHEN contains(lower(p_name),'small') OR contains(lower(p_name),'red') THEN 5
      WHEN contains(lower(p_name),'widget') THEN 4 END AS tier FROM part""")
def _(t):
    return t.part.select("p_partkey", X.phrase_tier(F.col("p_name"), [(["ring", "bolt"], 6), (["small", "red"], 5), (["widget"], 4)]).alias("tier"))


@query("phrase_exact", """
    SELECT o_orderkey, CASE WHEN lower(o_orderpriority) IN ('1-urgent','2-high') THEN 'fast' WHEN lower(o_orderpriority)='5-low' THEN 'slow' ELSE 'other' END AS speed FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", X.phrase_exact(F.lower("o_orderpriority"), [(["1-urgent", "2-high"], "fast"), (["5-low"], "slow")], "other").alias("speed"))


@query("day_arithmetic", """
    SELECT o_orderkey, date_diff('day', o_orderdate::date, DATE '2000-01-01')::int AS age_days, strftime(o_orderdate::date + 14,'%Y-%m-%d') AS plus, strftime(o_orderdate::date - 280,'%Y-%m-%d') AS minus,
      strftime((o_orderdate::date - INTERVAL 6 MONTH)::date + 3,'%Y-%m-%d') AS shifted FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", X.day_diff(F.lit("2000-01-01").cast("date"), d).alias("age_days"), day(X.day_add(d, 14)).alias("plus"),
        day(X.day_sub(d, 280)).alias("minus"), day(X.shift(d, days=3, months=-6)).alias("shifted"),
    )


@query("durations", """
    WITH f AS (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id) AS f FROM events)
    SELECT event_id, round((epoch(date_trunc('second',ts)) - epoch(date_trunc('second',f)))/86400 + 1e-6, 2) AS days, round(date_diff('microsecond', f, ts)/86400000000.0 + 1e-8, 6) AS frac FROM f""")
def _(t):
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("f"))
    e = t.events.join(first, "user_id")
    whole = X.duration_days(F.date_trunc("second", "f"), F.date_trunc("second", "ts"), 8)
    return e.select("event_id", F.round(whole + F.lit(1e-6), 2).alias("days"), rnd(X.frac_days(F.col("ts"), F.col("f"))).alias("frac"))


@query("date_parts", """
    SELECT event_id, year(ts)::int AS y, month(ts)::int AS m, day(ts)::int AS d, hour(ts)::int AS h FROM events""")
def _(t):
    return t.events.select("event_id", *[X.part(F.col("ts"), u).alias(u[0]) for u in ("year", "month", "day", "hour")])


@query("age_in_years", """
    SELECT l_orderkey, l_linenumber, round(date_diff('day', o_orderdate::date, l_shipdate::date)/365.25, 1) AS age FROM lineitem JOIN orders ON o_orderkey=l_orderkey""")
def _(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return pairs.select("l_orderkey", "l_linenumber", X.age_at(F.col("l_shipdate"), F.col("o_orderdate")).alias("age"))


@query("number_casts", """
    SELECT c_custkey, round(c_acctbal)::bigint AS r, floor(c_acctbal/1000)::bigint AS f, TRY_CAST(substr(c_mktsegment,1,1) AS DOUBLE) AS bad, TRY_CAST(right(c_name,3) AS BIGINT) AS num FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", F.round("c_acctbal").cast("long").alias("r"), F.floor(F.col("c_acctbal") / 1000).alias("f"),
        X.to_number(F.substring("c_mktsegment", 1, 1)).alias("bad"), X.to_number(F.right(F.col("c_name"), F.lit(3)), "long").alias("num"),
    )


@query("min_max_scale", """
    SELECT c_custkey, round((c_acctbal-min(c_acctbal) OVER ())/(max(c_acctbal) OVER ()-min(c_acctbal) OVER ())+1e-8,6) AS scaled, 0.0::DOUBLE AS constant FROM customer""")
def _(t):
    r = X.min_max(t.customer.withColumn("constant", F.lit(5.0)), ["c_acctbal", "constant"])
    return r.select("c_custkey", rnd("c_acctbal").alias("scaled"), "constant")


@query("standard_scale", """
    SELECT c_custkey, round((c_acctbal-avg(c_acctbal) OVER ())/stddev_pop(c_acctbal) OVER ()+1e-8,6) AS z FROM customer""")
def _(t):
    return X.z_score(t.customer, ["c_acctbal"]).select("c_custkey", rnd("c_acctbal").alias("z"))


USER_DAYS = "WITH d AS (SELECT user_id, ts::date AS d, min(event_type) AS k FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS rn FROM d) "


def _user_days(t):
    """Distinct days per user with the day's smallest kind: arrays bounded by the days observed."""
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("event_type").alias("k"))
    rows = daily.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "k"))).alias("rows"))
    return rows.select("user_id", F.col("rows.d").alias("days"), F.col("rows.k").alias("kinds"))


@query("nth_distinct_date", USER_DAYS + """
    SELECT user_id, strftime(max(d) FILTER (rn=1),'%Y-%m-%d') AS d1, strftime(max(d) FILTER (rn=2),'%Y-%m-%d') AS d2, strftime(max(d) FILTER (rn=29),'%Y-%m-%d') AS d29 FROM r GROUP BY 1""")
def _(t):
    u = _user_days(t)
    return u.select("user_id", day(X.first_of(F.col("days"))).alias("d1"), day(X.nth_distinct(F.col("days"), 2)).alias("d2"), day(X.nth_distinct(F.col("days"), 29)).alias("d29"))


@query("explode_array", USER_DAYS + "SELECT user_id, strftime(d,'%Y-%m-%d') AS d FROM d")
def _(t):
    return X.explode_col(_user_days(t).select("user_id", "days"), "days").select("user_id", day("days").alias("d"))


@query("array_membership", USER_DAYS + """
    SELECT user_id, bool_or(k IN ('error','purchase'))::int AS any_bad, bool_and(k IN ('click','error'))::int AS only_click_error,
      bool_or(NOT contains(k,'click') AND NOT contains(k,'err'))::int AS other FROM d GROUP BY 1""")
def _(t):
    k = F.col("kinds")
    return _user_days(t).select(
        "user_id", X.any_in(k, ["error", "purchase"]).cast("int").alias("any_bad"), X.all_in(k, ["click", "error"]).cast("int").alias("only_click_error"),
        X.any_without(k, ["CLICK", "err"]).cast("int").alias("other"),
    )


@query("exists_within_6_months", """
    SELECT c_custkey, coalesce(bool_or(o_orderdate::date < DATE '1999-06-30' AND DATE '1999-06-30' < o_orderdate::date + INTERVAL 6 MONTH),false)::int AS covered
    FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1""")
def _(t):
    days = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.to_date("o_orderdate")).alias("days"))
    covered = X.any_within(F.col("days"), F.lit("1999-06-30").cast("date"), 6)
    return t.customer.join(days, "c_custkey", "left").select("c_custkey", covered.cast("int").alias("covered"))


@query("first_in_range_scan", USER_DAYS + """
    SELECT user_id, strftime(min(d) FILTER (k='error' AND d BETWEEN DATE '2024-01-08' AND DATE '2024-01-25'),'%Y-%m-%d') AS hit FROM d GROUP BY 1""")
def _(t):
    hit = X.first_match(F.col("days"), F.col("kinds"), "error", F.lit("2024-01-08").cast("date"), F.lit("2024-01-25").cast("date"))
    return _user_days(t).select("user_id", day(hit).alias("hit"))


@query("token_map_max", """
    SELECT p_partkey, nullif(greatest(CASE WHEN list_contains(string_split(p_name,' '),'small') THEN 1 ELSE -1 END, CASE WHEN list_contains(string_split(p_name,' '),'ring') THEN 3 ELSE -1 END,
      CASE WHEN list_contains(string_split(p_name,' '),'bolt') THEN 2 ELSE -1 END),-1) AS level FROM part""")
def _(t):
    return t.part.select("p_partkey", X.token_max(F.col("p_name"), " ", {"small": 1, "ring": 3, "bolt": 2}).alias("level"))


@query("dictionary_recode", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 ELSE -1 END AS rank FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", X.recode_map(F.col("o_orderpriority"), {"1-URGENT": 5, "2-HIGH": 4}, -1).alias("rank"))


@query("result_classes", """
    WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' Detected. ' WHEN 'view' THEN 'Not  Detected (*)' WHEN 'purchase' THEN 'See: Comment' WHEN 'signup' THEN 'negatiev' END AS txt FROM events)
    SELECT event_id, CASE txt WHEN ' Detected. ' THEN 'positive' WHEN 'Not  Detected (*)' THEN 'negative' WHEN 'See: Comment' THEN 'see report or comment' WHEN 'negatiev' THEN 'negative' ELSE 'unknown' END AS result FROM r""")
def _(t):
    txt = X.recode_map(F.col("event_type"), {"click": " Detected. ", "view": "Not  Detected (*)", "purchase": "See: Comment", "signup": "negatiev"})
    return t.events.select("event_id", C.result_short(txt).alias("result"))


@query("result_list_category", USER_DAYS + """
    SELECT user_id, CASE WHEN bool_or(k='error') THEN '>= 1 positive' WHEN bool_or(k='signup') THEN '>= 1 negative (no positive)' ELSE 'inconclusive or unknown' END AS category FROM d GROUP BY 1""")
def _(t):
    short = F.transform("kinds", lambda k: X.recode_map(k, {"error": "positive", "signup": "negative"}, "unknown"))
    return _user_days(t).select("user_id", C.result_category(short).alias("category"))


@query("stage_and_category", """
    WITH d AS (SELECT o_orderkey, (o_totalprice/1000)::int AS days FROM orders)
    SELECT o_orderkey, CASE WHEN days<=90 THEN '1st trimester' WHEN days<=181 THEN '2nd trimester' ELSE '3rd trimester' END AS stage,
      CASE WHEN days<=91 THEN 'a' WHEN days<=189 THEN 'b' ELSE 'c' END AS stage_alt,
      CASE WHEN days>=259 THEN 'term' WHEN days>=238 THEN 'late_preterm' WHEN days>=224 THEN 'moderate_preterm' WHEN days>=196 THEN 'very_preterm' ELSE 'extremely_preterm' END AS category FROM d""")
def _(t):
    days = F.round(F.col("o_totalprice") / 1000).cast("int")
    return t.orders.select("o_orderkey", C.stage(days).alias("stage"), C.stage(days, (91, 189), ("a", "b", "c")).alias("stage_alt"), C.gestation_category(days).alias("category"))


@query("bins_and_periods", """
    SELECT p_partkey, CASE WHEN p_size<15 THEN -1 WHEN p_size<18.5 THEN 0 WHEN p_size<25 THEN 1 WHEN p_size<30 THEN 2 WHEN p_size<35 THEN 3 WHEN p_size<40 THEN 4 ELSE -1 END AS bmi FROM part""")
def _(t):
    return t.part.select("p_partkey", C.bin_code(F.col("p_size"), [15, 18.5, 25, 30, 35, 40], [-1, 0, 1, 2, 3, 4, -1], -1).alias("bmi"))


@query("era_by_date", """
    SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1996-01-01' THEN NULL WHEN o_orderdate < DATE '1998-07-03' THEN 'first' WHEN o_orderdate < DATE '2000-12-25' THEN 'second' ELSE NULL END AS era FROM orders""")
def _(t):
    era = C.period(F.to_date("o_orderdate"), [("first", "1996-01-01", "1998-07-03"), ("second", "1998-07-03", "2000-12-25")])
    return t.orders.select("o_orderkey", era.alias("era"))


@query("multi_category", """
    WITH s AS (SELECT DISTINCT o_custkey, CASE o_orderpriority WHEN '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
    g AS (SELECT o_custkey, count(*) AS n, min(p) AS one, count(*) FILTER (p<>'5-LOW') AS named, min(p) FILTER (p<>'5-LOW') AS one_named FROM s GROUP BY 1)
    SELECT c.o_custkey, CASE WHEN n IS NULL THEN 'Unknown' WHEN n=1 THEN one WHEN named=1 THEN one_named ELSE 'Multiracial' END AS category FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN g USING (o_custkey)""")
def _(t):
    sets = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
    return sets.select("o_custkey", C.consolidate(F.col("a"), {"2-HIGH": "1-URGENT"}, ["4-NOT SPECIFIED"], other="5-LOW").alias("category"))


@query("preterm_history", """
    SELECT o_orderkey, CASE WHEN coalesce(n,0)=0 OR (n=1 AND days<259) THEN 0 ELSE 1 END AS history FROM (
      SELECT o_orderkey, nullif(left(o_orderpriority,1)::int - 1, 4) AS n, floor(o_totalprice/1000) AS days FROM orders)""")
def _(t):
    n = F.nullif(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(4))
    return t.orders.select("o_orderkey", C.preterm_history(n, F.floor(F.col("o_totalprice") / 1000)).alias("history"))


@query("overall_severity", """
    SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN 'Dead' WHEN o_totalprice>300000 THEN 'Severe' WHEN o_totalprice>150000 THEN 'Moderate' ELSE 'Mild' END AS severity FROM orders""")
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", C.severity(F.col("o_orderstatus") == "P", price > 300000, price > 150000).alias("severity"))


@query("offset_fallback", """
    SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus='F' THEN date_diff('day',o_orderdate::date,l_shipdate::date)+280 WHEN o_orderpriority<>'5-LOW' THEN date_diff('day',o_orderdate::date,l_shipdate::date) END AS day_no
    FROM lineitem JOIN orders ON o_orderkey=l_orderkey""")
def _(t):
    pairs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    end, start = F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate END"), F.expr("CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END")
    return pairs.select("l_orderkey", "l_linenumber", C.offset_with_fallback(F.col("l_shipdate"), [(end, 280), (start, 0)]).cast("long").alias("day_no"))


@query("published_encodings", """
    SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL OR q<2 THEN 0 WHEN q<5 THEN 1 ELSE 2 END AS parity, CASE WHEN q IS NULL OR q<2 THEN 0 WHEN q<6 THEN 1 ELSE 2 END AS gravidity,
      CASE WHEN q<18.5 THEN 0 WHEN q<25 THEN 1 WHEN q<30 THEN 2 WHEN q<35 THEN 3 WHEN q<40 THEN 4 ELSE -1 END AS bmi, CASE WHEN q<25 THEN 0 WHEN q<30 THEN 1 WHEN q<35 THEN 2 WHEN q<40 THEN 3 WHEN q<45 THEN 4 ELSE -1 END AS age,
      CASE WHEN r<4 THEN 'Metropolitan' WHEN r<7 THEN 'Micropolitan' WHEN r<10 THEN 'SmallTown' WHEN r<99 THEN 'Rural' WHEN r=99 THEN 'NotCoded' END AS area,
      CASE WHEN r<4 THEN 3 WHEN r<7 THEN 2 WHEN r<10 THEN 1 WHEN r<99 THEN 0 ELSE -1 END AS area_rank, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE -1 END AS delivery
    FROM (SELECT *, nullif(l_quantity,7) AS q, CASE WHEN l_quantity>45 THEN 99.0 WHEN l_quantity>40 THEN 120.0 ELSE l_quantity/2 END AS r FROM lineitem)""")
def _(t):
    q = F.nullif("l_quantity", F.lit(7.0))
    r = F.when(F.col("l_quantity") > 45, 99.0).when(F.col("l_quantity") > 40, 120.0).otherwise(F.col("l_quantity") / 2)
    method = X.recode_map(F.col("l_returnflag"), {"A": "Vaginal, Breech", "R": "C-Section, Classical"}, "other")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", *[C.encode(q, n).alias(n) for n in ("parity", "gravidity", "bmi", "age")],
        C.rurality(r).alias("area"), C.rurality_rank(C.rurality(r)).alias("area_rank"), C.delivery_method(method).alias("delivery"),
    )
