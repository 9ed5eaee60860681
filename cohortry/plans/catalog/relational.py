"""Filters, joins, ordering and set operations."""

from pyspark.sql import functions as F

from cohortry.operators import aggregate as A
from cohortry.operators import filters as P
from cohortry.operators import joins as J
from cohortry.operators import ordering as S
from cohortry.plans.catalog.shared import day
from cohortry.plans.registry import query


@query("project_rename", "SELECT o_orderkey AS episode, o_custkey AS person, o_totalprice AS amount FROM orders")
def _(t):
    return P.project(t.orders, {"episode": "o_orderkey", "person": "o_custkey", "amount": "o_totalprice"})


@query("rename_suffix", "SELECT c_custkey AS c_custid, c_nationkey, c_acctbal FROM customer")
def _(t):
    return P.rename_suffix(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "custkey", "custid")


@query("half_open_dates", """
    SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS d FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1998-03-01'""")
def _(t):
    o = t.orders.where(P.in_range(F.col("o_orderdate"), F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1998-03-01").cast("timestamp_ntz")))
    return o.select("o_orderkey", day("o_orderdate").alias("d"))


@query("eligibility", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F' AND o_totalprice BETWEEN 50000 AND 200000 AND o_orderpriority <= '3-MEDIUM'""")
def _(t):
    r = P.eligible(t.orders, [F.col("o_orderstatus") == "F", "o_totalprice BETWEEN 50000 AND 200000", F.col("o_orderpriority") <= "3-MEDIUM"])
    return r.select("o_orderkey", "o_totalprice")


@query("require_grain", "SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'")
def _(t):
    o = t.orders.select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"), F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    return P.require(o, ["p", "s"]).drop("s")


@query("any_concept_filter", """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag='R' OR (CASE WHEN l_discount > 0.07 THEN l_discount END) IS NOT NULL""")
def _(t):
    lines = t.lineitem.withColumns({"returned": F.col("l_returnflag") == "R", "big_discount": F.when(F.col("l_discount") > 0.07, F.col("l_discount"))})
    return P.any_concept(lines, ["returned", "big_discount"]).select("l_orderkey", "l_linenumber")


@query("text_filters", """
    SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE 's%' AND p_type NOT LIKE '%ECON%' AND p_brand IN ('Brand#11','Brand#12','Brand#3')""")
def _(t):
    r = P.text_filter(t.part, "p_name", like="s%")
    r = P.text_filter(r, "p_type", contains="ECON", negate=True)
    r = P.text_filter(r, "p_brand", isin=["Brand#11", "Brand#12", "Brand#3"])
    return r.select("p_partkey", "p_name", "p_type")


@query("active_at_index", """
    SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY AND (CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL 90 DAY END IS NULL
      OR l_shipdate + INTERVAL 90 DAY >= o_orderdate + INTERVAL 60 DAY) AND l_linestatus <> 'O'""")
def _(t):
    pairs = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.expr("o_orderdate + INTERVAL '60' DAY")
    resolved = F.expr("CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL '90' DAY END")
    status = F.when(F.col("l_linestatus") == "O", "Deleted")
    return pairs.where(P.active_at(F.col("l_shipdate"), resolved, status, at)).select("o_orderkey", "l_linenumber")


@query("exclude_any_flag", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag='R') AND NOT (l_tax > 0.06)")
def _(t):
    lines = t.lineitem.withColumns({"c1": F.when(F.col("l_returnflag") == "R", 1), "c2": (F.col("l_tax") > 0.06).cast("int")})
    return P.exclude_any(lines, ["c1", "c2"]).select("l_orderkey", "l_linenumber")


@query("attrition", """
    WITH c AS (SELECT count(*) AS c0, count(*) FILTER (o_orderstatus='F') AS c1, count(*) FILTER (o_orderstatus='F' AND o_totalprice>100000) AS c2,
      count(*) FILTER (o_orderstatus='F' AND o_totalprice>100000 AND o_orderpriority<>'5-LOW') AS c3 FROM orders)
    SELECT 0 AS step, 'all' AS criterion, c0 AS remaining FROM c UNION ALL SELECT 1,'finished',c1 FROM c
    UNION ALL SELECT 2,'large',c2 FROM c UNION ALL SELECT 3,'not_low',c3 FROM c""")
def _(t):
    return P.attrition(t.orders, [("finished", "o_orderstatus = 'F'"), ("large", F.col("o_totalprice") > 100000), ("not_low", "nullif(o_orderpriority, '5-LOW') IS NOT NULL")])


@query("recode_case", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderpriority END AS state FROM orders""")
def _(t):
    state = P.recode(F.col("o_orderstatus"), {"F": "final", "O": "open"}, F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", state.alias("state"))


@query("sentinel_and_fill", """
    SELECT p_partkey, coalesce(nullif(p_size, 1), -7) AS p_size, coalesce(nullif(p_brand,'Brand#11'),'none') AS p_brand FROM part""")
def _(t):
    r = P.null_if(P.null_if(t.part.select("p_partkey", "p_size", "p_brand"), ["p_size"], 1), ["p_brand"], "Brand#11")
    return P.fill(r, {"p_size": -7, "p_brand": "none"})


@query("common_column_join", "SELECT l_orderkey, l_linenumber, n FROM lineitem JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1,2) USING (l_orderkey, l_suppkey)")
def _(t):
    counts = A.row_counts(t.lineitem, ["l_orderkey", "l_suppkey"])
    keys = P.common_columns(t.lineitem, counts)
    return J.join(t.lineitem, counts, keys).select("l_orderkey", "l_linenumber", "n")


@query("join_inner_composite", """
    SELECT l_orderkey, l_linenumber, l_quantity, total FROM lineitem
    JOIN (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2) USING (l_orderkey, l_returnflag)""")
def _(t):
    totals = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("total"))
    return J.join(t.lineitem, totals, ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_quantity", "total")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus='P') ON o_custkey=c_custkey")
def _(t):
    o = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.join(t.customer.select("c_custkey"), o, ["c_custkey"], "left")


@query("join_right", """
    SELECT o_orderkey, c_mktsegment FROM (SELECT * FROM customer WHERE c_mktsegment='BUILDING') RIGHT JOIN orders ON o_custkey=c_custkey""")
def _(t):
    c = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.join(c, t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "right").drop("o_custkey")


@query("join_small_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey=c_nationkey")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.join(t.customer, n, ["c_nationkey"]).select("c_custkey", "n_name")


@query("join_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')")
def _(t):
    o = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.join(t.customer, o, ["c_custkey"], "left_anti").select("c_custkey")


@query("anti_range", """
    SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY)""")
def _(t):
    days = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").distinct()
    cond = "b.l_shipdate BETWEEN a.o_orderdate AND a.o_orderdate + INTERVAL '30' DAY"
    return J.join(t.orders, days, ["o_orderkey"], "left_anti", cond).select("o_orderkey")


@query("join_left_semi", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT')")
def _(t):
    o = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.join(t.customer, o, ["c_custkey"], "left_semi").select("c_custkey")


@query("not_exists_flag", """
    SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT') THEN 1 ELSE 0 END AS never_urgent FROM customer""")
def _(t):
    t.customer.createOrReplaceTempView("fl_customer")
    t.orders.createOrReplaceTempView("fl_orders")
    never = t.spark.sql("SELECT c_custkey FROM fl_customer c WHERE NOT EXISTS (SELECT 1 FROM fl_orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
    return J.status_flag(t.customer.select("c_custkey"), never, ["c_custkey"], "never_urgent")


@query("join_inequality", """
    SELECT o_orderkey, strftime(f,'%Y-%m-%d') AS first_ship FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS f FROM lineitem GROUP BY 1)
    ON l_orderkey=o_orderkey AND f > o_orderdate + INTERVAL 20 DAY""")
def _(t):
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("f"))
    r = J.join(t.orders, first, ["o_orderkey"], "inner", "b.f > a.o_orderdate + INTERVAL '20' DAY")
    return r.select("o_orderkey", day("f").alias("first_ship"))


BAND_SQL = """
    SELECT o_orderkey, l_linenumber, date_diff('day', o_orderdate::date, l_shipdate::date) AS lag FROM orders JOIN lineitem ON l_orderkey=o_orderkey
      AND l_shipdate::date BETWEEN o_orderdate::date + 14 AND o_orderdate::date + 60"""


@query("band_join", BAND_SQL)
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("ship"))
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("od"))
    r = J.join(o, lines, ["o_orderkey"], "inner", "b.ship BETWEEN date_add(a.od, 14) AND date_add(a.od, 60)")
    return r.select("o_orderkey", "l_linenumber", F.datediff("ship", "od").cast("long").alias("lag"))


@query("range_join_cells", BAND_SQL)
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("ship"))
    spans = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("od")).withColumns({"lo": F.date_add("od", 14), "hi": F.date_add("od", 60)})
    r = J.range_join(lines, spans, ["o_orderkey"], "ship", "lo", "hi", bucket=50)
    return r.select("o_orderkey", "l_linenumber", F.datediff("ship", "od").cast("long").alias("lag"))


@query("range_join_no_key", """
    SELECT p_partkey, b.name AS band FROM part JOIN (VALUES ('low',900.0,1000.0),('mid',1000.005,1300.0),('high',1300.005,2500.0)) b(name,lo,hi) ON p_retailprice BETWEEN lo AND hi""")
def _(t):
    bands = t.spark.createDataFrame([("low", 900.0, 1000.0), ("mid", 1000.005, 1300.0), ("high", 1300.005, 2500.0)], "band string, lo double, hi double")
    return J.range_join(t.part, bands, [], "p_retailprice", "lo", "hi", bucket=100).select("p_partkey", "band")


@query("self_join_parent", """
    SELECT c.conv_id, c.turn, c.role, p.role AS parent_role FROM conversations c JOIN conversations p ON p.conv_id=c.conv_id AND p.turn=c.turn-1""")
def _(t):
    c = t.conversations.select("conv_id", "turn", "role", F.concat_ws("|", "conv_id", "turn").alias("id"), F.concat_ws("|", "conv_id", F.col("turn") - 1).alias("parent"))
    return J.link_children(c, "id", "parent", ["role"]).select("conv_id", "turn", "role", "parent_role")


@query("join_chain", """
    SELECT c_custkey, n_name, r_name, o_orderkey FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey
    LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority='1-URGENT') ON o_custkey=c_custkey""")
def _(t):
    for name in ("customer", "nation", "region", "orders"):
        getattr(t, name).createOrReplaceTempView(f"ch_{name}")
    return t.spark.sql("""
        SELECT c.c_custkey, n.n_name, r.r_name, o.o_orderkey FROM ch_customer c JOIN ch_nation n ON n.n_nationkey = c.c_nationkey
        JOIN ch_region r ON r.r_regionkey = n.n_regionkey
        LEFT JOIN ch_orders o ON o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT'""")


@query("spine_join", """
    WITH a AS (SELECT o_orderdate::date AS d, count(*) AS orders_n FROM orders GROUP BY 1), b AS (SELECT l_shipdate::date AS d, count(*) AS lines_n FROM lineitem GROUP BY 1),
    s AS (SELECT d FROM a UNION SELECT d FROM b)
    SELECT strftime(d,'%Y-%m-%d') AS d, orders_n, lines_n FROM s LEFT JOIN a USING (d) LEFT JOIN b USING (d)""")
def _(t):
    a = t.orders.groupBy(day("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("orders_n"))
    b = t.lineitem.groupBy(day("l_shipdate").alias("d")).agg(F.count(F.lit(1)).alias("lines_n"))
    return J.spine_join([a, b], ["d"])


@query("status_flag", """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R') THEN 1 ELSE 0 END AS returned FROM orders""")
def _(t):
    hits = t.lineitem.where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.status_flag(t.orders.select("o_orderkey"), hits, ["o_orderkey"], "returned")


@query("sort_mixed", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC")
def _(t):
    return S.sort(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", True), ("o_totalprice", False)])


@query("top1_per_group", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn=1""")
def _(t):
    return S.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)])


@query("top3_per_group", """
    SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn<=3""")
def _(t):
    order = [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True)]
    return S.top_per_group(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], order, 3).drop("l_extendedprice")


@query("pick_priority", "SELECT o_custkey, min_by(o_orderstatus, (o_orderpriority, o_orderstatus)) AS o_orderstatus FROM orders GROUP BY 1")
def _(t):
    return S.pick_priority(t.orders, ["o_custkey"], "o_orderstatus", "o_orderpriority")


@query("earliest_record", """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn=1""")
def _(t):
    return S.earliest(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts").drop("ts")


@query("top_k_global", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
def _(t):
    return S.top_k(t.part.select("p_partkey", "p_retailprice"), [("p_retailprice", False), ("p_partkey", True)], 7)


@query("seeded_shuffle")
def _(t):
    return S.shuffle(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", 457)


@query("union_all", "SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def _(t):
    return S.union_all(t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")), t.supplier.select(F.lit("s").alias("src"), F.col("s_nationkey").alias("k")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return S.union_distinct(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query("union_one_per_key", "SELECT k, min(v) AS v FROM (SELECT c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1")
def _(t):
    c = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    return S.union_distinct(c, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")), keys=["k"])


@query("cohort_difference", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def _(t):
    return S.difference(t.orders.select("o_orderkey", "o_custkey"), t.orders.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("cohort_intersection", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def _(t):
    return S.intersect(t.orders.select("o_orderkey", "o_custkey"), t.orders.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("key_spine", "SELECT l_orderkey AS k FROM lineitem UNION SELECT o_orderkey FROM orders")
def _(t):
    return S.key_spine([t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k"))], ["k"])

