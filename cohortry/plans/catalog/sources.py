"""Scans, sinks and cohort-scoped extraction."""

import uuid

from pyspark.sql import functions as F

from cohortry.functions.scalars import age_at
from cohortry.operators import concepts as K
from cohortry.plans.catalog.shared import day
from cohortry.plans.registry import query
from cohortry.sources import extract as E
from cohortry.sources import io, specs


@query("scan_date_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01'")
def _(t):
    io.register(t.orders, "io_orders")
    r = io.scan(t.spark, "io_orders", "o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-07-01'")
    return r.select("o_orderkey", "o_totalprice")


@query("inline_lookup", """
    SELECT o_orderkey, r.rank FROM orders JOIN (VALUES ('1-URGENT',5),('2-HIGH',4),('3-MEDIUM',3)) r(p,rank) ON p=o_orderpriority""")
def _(t):
    ranks = io.inline(t.spark, [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3)], "o_orderpriority string, rank int")
    return t.orders.join(ranks, "o_orderpriority").select("o_orderkey", "rank")


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = io.scratch_folder(t.spark) + "/nation"
    t.nation.write.csv(path, header=True)
    return io.read_csv(t.spark, path, t.nation.schema)


@query("json_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = io.scratch_folder(t.spark) + "/supplier"
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    s.write.json(path)
    return io.read_json(t.spark, path, s.schema)


@query("table_round_trip", """
    SELECT p_partkey, p_brand, count(*) AS copies, 0 AS second_write FROM (SELECT * FROM part UNION ALL SELECT * FROM part) GROUP BY 1, 2""")
def _(t):
    name, path = f"rt_{uuid.uuid4().hex}", io.scratch_folder(t.spark) + "/part"
    part = t.part.select("p_partkey", "p_brand")
    io.save_table(part, name, path=path)
    second = io.save_table(part, name)
    io.append_table(part.select("p_brand", "p_partkey"), name)
    io.analyze(t.spark, name)
    stored = io.scan(t.spark, name)
    return stored.groupBy("p_partkey", "p_brand").agg(F.count(F.lit(1)).alias("copies")).withColumn("second_write", F.lit(int(second)))


@query("materialized_step", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return io.materialize(counts, path=io.scratch_folder(t.spark) + "/counts")


@query("bucketed_stages", """
    WITH a AS (SELECT o_custkey AS p, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1),
    b AS (SELECT o_custkey AS p, max(l_quantity) AS largest, count(*) AS n_lines FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1)
    SELECT c_custkey, c_mktsegment, coalesce(n,0) AS n, coalesce(n_lines,0) AS n_lines, largest FROM customer LEFT JOIN a ON a.p=c_custkey LEFT JOIN b ON b.p=c_custkey""")
def _(t):
    """Three steps of a cohort, stored by person and joined as they lie."""
    store = lambda df: io.stage(df, ["c_custkey"], path=io.scratch_folder(t.spark) + "/stage")
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    counts = store(orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")))
    lines = t.lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("c_custkey").agg(F.max("l_quantity").alias("largest"), F.count(F.lit(1)).alias("n_lines"))
    people = store(t.customer.select("c_custkey", "c_mktsegment"))
    return people.join(counts, "c_custkey", "left").join(store(lines), "c_custkey", "left").na.fill(0, ["n", "n_lines"]).select("c_custkey", "c_mktsegment", "n", "n_lines", "largest")


@query("table_housekeeping", """
    SELECT * FROM (VALUES ('stored', 1, 1), ('again', 0, 1), ('dropped', 1, 0), ('dropped again', 0, 0)) v(step, done, listed), (SELECT count(*) AS n_rows FROM region)""")
def _(t):
    """Write, refuse, drop and list tables: whether each step did something, and whether the table is listed after it."""
    name, path = f"kept_{uuid.uuid4().hex}", io.scratch_folder(t.spark) + "/kept"
    steps, rows = [], t.region.count()

    def note(step: str, done: bool) -> None:
        steps.append((step, int(done), int(name in io.list_tables(t.spark)), rows))

    note("stored", io.save_table(t.region, name, path=path))
    note("again", io.save_table(t.region, name, path=path))
    note("dropped", io.drop_table(t.spark, name))
    note("dropped again", io.drop_table(t.spark, name))
    return t.spark.createDataFrame(steps, "step string, done int, listed int, n_rows long")


@query("person_sets", """
    SELECT c_custkey, c_mktsegment, priorities FROM customer LEFT JOIN
      (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1) ON o_custkey=c_custkey
    WHERE c_acctbal > 0""")
def _(t):
    attrs = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    r = E.person_cohort(t.customer, attrs, ["c_custkey"], "o_orderpriority", omit=["c_name", "c_nationkey"], where="c_acctbal > 0")
    return r.select("c_custkey", "c_mktsegment", F.array_join("o_orderpriority", "|").alias("priorities"))


def _encounter_spec(t):
    """customer as person, orders as encounters, lineitem as an optional detail table, part as a lookup."""
    orders = t.orders.withColumn("person", F.col("o_custkey"))
    base = E.Part(orders, ["person"], omit=("o_custkey",))
    lines = E.Part(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], omit=("l_tax", "l_discount"))
    return E.ExtractSpec(base, {"lines": lines}, (), ("o_orderdate", "birth", "age_at_order"))


def _persons(t):
    return t.customer.select(F.col("c_custkey").alias("person"), "c_mktsegment", F.lit("1990-01-01").cast("date").alias("birth"))


@query("extract_encounters", """
    SELECT c_custkey AS person, o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS d, round(date_diff('day', DATE '1990-01-01', o_orderdate::date)/365.25,1) AS age_at_order
    FROM customer LEFT JOIN orders ON o_custkey=c_custkey WHERE o_orderstatus='F'""")
def _(t):
    r = E.extract(_persons(t), _encounter_spec(t), keep=["birth"], where="o_orderstatus = 'F'")
    return r.select("person", "o_orderkey", day("o_orderdate").alias("d"), "age_at_order")


@query("extract_visits", """
    SELECT o_custkey AS pat_id, 1 AS instance, o_orderkey AS pat_enc_csn_id, strftime(o_orderdate,'%Y-%m-%d') AS contact_date, o_orderstatus AS enc_type, l_linenumber AS adt_event
    FROM customer JOIN orders ON o_custkey=c_custkey LEFT JOIN lineitem ON l_orderkey=o_orderkey WHERE c_mktsegment='BUILDING'""")
def _(t):
    """The usual spec with its default omissions: acuity and bed are left out."""
    visit = t.orders.select(F.col("o_custkey").alias("pat_id"), F.lit(1).alias("instance"), F.col("o_orderkey").alias("pat_enc_csn_id"), day("o_orderdate").alias("contact_date"), F.col("o_orderstatus").alias("enc_type"), F.col("o_orderpriority").alias("acuity"))
    moves = t.lineitem.join(visit.select("pat_id", "instance", "pat_enc_csn_id"), F.col("l_orderkey") == F.col("pat_enc_csn_id"))
    moves = moves.select("pat_id", "instance", "pat_enc_csn_id", F.col("l_linenumber").alias("adt_event"), F.col("l_suppkey").alias("adt_bed_id"))
    people = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("pat_id"), F.lit(1).alias("instance"))
    return E.extract(people, specs.encounters({"encounter": visit, "adtevent": moves}), join="adtevent", where="pat_enc_csn_id IS NOT NULL")


@query("extract_encounter_details", """
    SELECT c_custkey AS person, c_mktsegment, o_orderkey, l_linenumber, l_partkey FROM customer LEFT JOIN orders ON o_custkey=c_custkey LEFT JOIN lineitem ON l_orderkey=o_orderkey""")
def _(t):
    r = E.extract(_persons(t), _encounter_spec(t), keep=["c_mktsegment"], join="lines")
    return r.select("person", "c_mktsegment", "o_orderkey", "l_linenumber", "l_partkey")


@query("extract_default_omit", """
    SELECT o_custkey AS person, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
      strftime(o_orderdate,'%Y-%m-%d') AS o_orderdate, strftime(l_shipdate,'%Y-%m-%d') AS l_shipdate FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey""")
def _(t):
    r = E.extract(None, _encounter_spec(t), join="lines")
    return r.withColumns({"o_orderdate": day("o_orderdate"), "l_shipdate": day("l_shipdate")})


@query("extract_medications", """
    SELECT o_custkey AS person, o_orderkey, l_linenumber, p_name, p_type, (p_type='PROMO')::int AS promo, coalesce(p_brand IN ('Brand#1','Brand#2'),false)::int AS brand_ab
    FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey LEFT JOIN part ON p_partkey=l_partkey WHERE l_returnflag='A'""")
def _(t):
    lines = E.Part(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").withColumn("p_partkey", F.col("l_partkey")), ["o_orderkey"], omit=("l_comment",))
    spec = E.ExtractSpec(E.Part(t.orders.withColumnRenamed("o_custkey", "person"), ["person"]), {"administration": lines}, (E.Part(t.part, ["p_partkey"]),))
    ids = t.part.where("p_type = 'PROMO'").select("p_partkey", F.lit("promo").alias("label")).union(
        t.part.where("p_brand IN ('Brand#1', 'Brand#2')").select("p_partkey", F.lit("brand_ab").alias("label")))
    r = E.extract(
        None, spec, join="administration", where="l_returnflag = 'A'",
        concepts=(lambda df: K.add_flags(df, ids, ["p_partkey"], ["promo", "brand_ab"]),),
    )
    return r.select("person", "o_orderkey", "l_linenumber", "p_name", "p_type", F.col("promo").cast("int").alias("promo"), F.col("brand_ab").cast("int").alias("brand_ab"))


@query("extract_measurements", """
    SELECT u.user_id, event_id, code, value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id=u.user_id
    LEFT JOIN (VALUES ('click','C1'),('view','C2'),('error','C9')) m(k,code) ON m.k=e.event_type WHERE code IS NOT NULL""")
def _(t):
    codes = io.inline(t.spark, [("click", "C1"), ("view", "C2"), ("error", "C9")], "event_type string, code string")
    spec = E.ExtractSpec(E.Part(t.events, ["user_id"], omit=("props",)), {}, (E.Part(codes, ["event_type"]),))
    return E.extract(t.events.select("user_id").distinct(), spec, where="code IS NOT NULL").select("user_id", "event_id", "code", "value")


@query("extract_problem_list", """
    SELECT c_custkey AS person, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON o_custkey=c_custkey WHERE o_orderstatus<>'P' AND o_orderpriority IN ('1-URGENT','2-HIGH')""")
def _(t):
    columns = {c: c for c in ("o_orderkey", "o_orderpriority", "o_orderstatus")}
    spec = E.ExtractSpec(E.Part(t.orders.withColumnRenamed("o_custkey", "person"), ["person"], columns, omit=("o_orderstatus",)))
    return E.extract(_persons(t), spec, keep=[], where="o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").select("person", "o_orderkey", "o_orderpriority")


@query("extract_episodes", """
    SELECT c.conv_id, c.turn, length(c.text)::int AS n, s.first_role FROM conversations c LEFT JOIN (SELECT conv_id, min_by(role,turn) AS first_role FROM conversations GROUP BY 1) s USING (conv_id)""")
def _(t):
    base = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    summary = t.conversations.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"))
    spec = E.ExtractSpec(E.Part(base, ["conv_id"]), {"summary": E.Part(summary, ["conv_id"])})
    return E.extract(None, spec, join=["summary"])


@query("problem_snapshot", """
    SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority='1-URGENT') ON o_custkey=c_custkey""")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return E.snapshot(t.customer.select("c_custkey"), urgent, ["c_custkey"])


@query("flagged_fact_rows", """
    WITH f AS (SELECT l_orderkey, l_linenumber, p_type FROM lineitem JOIN part ON p_partkey=l_partkey WHERE p_type IN ('PROMO','LARGE') AND l_returnflag='R')
    SELECT o_orderkey, l_linenumber, coalesce(p_type='PROMO', NULL)::int AS promo, (p_type='LARGE')::int AS "large" FROM orders LEFT JOIN f ON l_orderkey=o_orderkey""")
def _(t):
    label = F.lower("p_type")
    ids = t.part.where("p_type IN ('PROMO', 'LARGE')").select(F.col("p_partkey").alias("l_partkey"), label.alias("label"))
    facts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", F.array("l_partkey").alias("parts"))
    r = E.flagged_facts(t.orders.select("o_orderkey"), facts, ["o_orderkey"], ids, ["l_partkey"], ["promo", "large"], "l_returnflag = 'R'", "parts")
    return r.select("o_orderkey", "l_linenumber", F.col("promo").cast("int").alias("promo"), F.col("large").cast("int").alias("large"))


@query("age_at_event", """
    SELECT o_orderkey, round(date_diff('day', DATE '1970-05-17', o_orderdate::date)/365.25,1) AS age FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", age_at(F.col("o_orderdate"), F.lit("1970-05-17").cast("date")).alias("age"))
