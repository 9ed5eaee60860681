"""Vocabulary expansion and concept columns. Regions and nations play a two-level code hierarchy."""

from pyspark.sql import functions as F

from cohortry.operators import concepts as K
from cohortry.plans.registry import query
from cohortry.sources.io import inline


def _vocabulary(t):
    """Concept table, ancestor closure (region → region and its nations) and a symmetric relationship."""
    r = t.region.select((F.col("r_regionkey") + 1000).cast("long").alias("concept_id"), F.concat(F.lit("R"), "r_regionkey").alias("concept_code"), F.col("r_name").alias("concept_name"))
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("concept_id"), F.concat(F.lit("N"), "n_nationkey").alias("concept_code"), F.col("n_name").alias("concept_name"))
    concept = r.union(n).withColumn("vocabulary_id", F.lit("GEO"))
    other = n.select("concept_id", "concept_code", F.lit("other").alias("concept_name"), F.lit("ALT").alias("vocabulary_id"))
    ids = t.nation.select((F.col("n_regionkey") + 1000).cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("d"))
    own = ids.select("a", F.col("a").alias("d")).distinct()
    ancestor = ids.union(own).toDF("ancestor_concept_id", "descendant_concept_id")
    rel = ids.union(ids.select(F.col("d").alias("a"), F.col("a").alias("d"))).toDF("concept_id_1", "concept_id_2")
    return concept, other, ancestor, rel


def _registry(t):
    return inline(t.spark, [("west", "R1"), ("east", "R2"), ("east", "R3"), ("mixed", "N5"), ("mixed", "R0"), ("lost", "ZZ")], "label string, code string")


REG = "WITH reg(label,code) AS (VALUES ('west','R1'),('east','R2'),('east','R3'),('mixed','N5'),('mixed','R0'),('lost','ZZ')), con AS (SELECT r_regionkey+1000 AS id, 'R'||r_regionkey AS code, r_name AS name FROM region UNION ALL SELECT n_nationkey, 'N'||n_nationkey, n_name FROM nation), edge AS (SELECT n_regionkey+1000 AS a, n_nationkey AS d FROM nation) "


@query("registry_labels", "SELECT c_mktsegment AS label, c_nationkey AS code FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY')")
def _(t):
    reg = t.customer.select(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("code"))
    return K.registry(reg, ["BUILDING", "MACHINERY"])


@query("codes_with_names", REG + "SELECT label, reg.code, id AS concept_id, name AS concept_name FROM reg LEFT JOIN con USING (code)")
def _(t):
    concept, other, *_ = _vocabulary(t)
    return K.codes(_registry(t), concept.unionByName(other), "GEO")


@query("descendants", REG + """
    SELECT label, reg.code, id AS concept_id, name AS concept_name FROM reg LEFT JOIN con USING (code)
    UNION SELECT label, c2.code, c2.id, c2.name FROM reg JOIN con USING (code) JOIN edge ON a=con.id JOIN con c2 ON c2.id=d""")
def _(t):
    concept, _other, ancestor, _rel = _vocabulary(t)
    return K.expand_descendants(K.codes(_registry(t), concept, "GEO"), concept, ancestor)


# Parts as a hierarchy of thirds (depth 7 and more), in which part 1 is also below part 5: 1, 5 and what lies under them form a cycle.
PARENTS = "e AS (SELECT p_partkey // 3 AS a, p_partkey AS d FROM part WHERE p_partkey >= 3 UNION SELECT 5, 1), "


def _parents(t):
    thirds = t.part.where("p_partkey >= 3").select(F.floor(F.col("p_partkey") / 3).cast("long").alias("up"), F.col("p_partkey").alias("part"))
    return thirds.union(t.spark.range(1).select(F.lit(5).cast("long"), F.lit(1).cast("long")))


@query("closure", "WITH RECURSIVE " + PARENTS + """
    r AS (SELECT a, d FROM e UNION SELECT r.a, e.d FROM r JOIN e ON e.a = r.d) SELECT a AS ancestor, d AS descendant FROM r""")
def _(t):
    r = K.closure(_parents(t), "up", "part")
    return r.select(F.col("ancestor_concept_id").alias("ancestor"), F.col("descendant_concept_id").alias("descendant"))


@query("descendants_from_edges", "WITH RECURSIVE " + PARENTS + """
    r AS (SELECT a, d FROM e WHERE a IN (2, 7) UNION SELECT r.a, e.d FROM r JOIN e ON e.a = r.d)
    SELECT 'L' || a AS label, p_name AS concept_name, p_partkey AS concept_id FROM (SELECT a, d FROM r UNION SELECT 2, 2 UNION SELECT 7, 7) JOIN part ON p_partkey = d""")
def _(t):
    """All parts below two of them, by labels, through the closure of the direct edges."""
    concept = t.part.select(F.col("p_partkey").alias("concept_id"), F.col("p_partkey").cast("string").alias("concept_code"), F.col("p_name").alias("concept_name"), F.lit("PART").alias("vocabulary_id"))
    wanted = t.part.where("p_partkey IN (2, 7)").select(F.concat(F.lit("L"), "p_partkey").alias("label"), F.col("p_partkey").cast("string").alias("code"))
    return K.expand_descendants(K.codes(wanted, concept, "PART"), concept, K.closure(_parents(t), "up", "part")).select("label", "concept_name", "concept_id")


@query("related_codes", REG + """
    SELECT label, reg.code, id AS concept_id, name AS concept_name FROM reg LEFT JOIN con USING (code)
    UNION SELECT label, c2.code, c2.id, c2.name FROM reg JOIN con USING (code) JOIN (SELECT a,d FROM edge UNION SELECT d,a FROM edge) e(a,d) ON a=con.id JOIN con c2 ON c2.id=d""")
def _(t):
    concept, _other, _anc, rel = _vocabulary(t)
    return K.expand_related(K.codes(_registry(t), concept, "GEO"), concept, rel)


def _id_map(t):
    """Customers as source ids, mapped to their nation code under GEO and to a segment under SEG."""
    geo = t.customer.select(F.col("c_custkey").alias("value"), F.length(F.col("c_custkey").cast("string")).alias("instance"), F.concat(F.lit("GEO#N"), "c_nationkey").alias("concept"))
    seg = t.customer.select(F.col("c_custkey").alias("value"), F.length(F.col("c_custkey").cast("string")).alias("instance"), F.concat(F.lit("SEG#"), "c_mktsegment").alias("concept"))
    return geo.union(seg)


LABELLED = REG + ", full_codes AS (SELECT label, reg.code FROM reg UNION SELECT label, c2.code FROM reg JOIN con USING (code) JOIN edge ON a=con.id JOIN con c2 ON c2.id=d), ids AS (SELECT DISTINCT label, c_custkey AS source_id, length(c_custkey::varchar)::int AS instance FROM full_codes JOIN customer ON 'N'||c_nationkey=full_codes.code) "


def _label_ids(t):
    concept, _other, ancestor, _rel = _vocabulary(t)
    return K.to_source_ids(K.expand_descendants(K.codes(_registry(t), concept, "GEO"), concept, ancestor), _id_map(t), "GEO")


@query("source_ids", LABELLED + "SELECT label, source_id, instance FROM ids")
def _(t):
    return _label_ids(t)


@query("restrict_to_concept", LABELLED + """
    SELECT o_orderkey FROM orders WHERE (o_custkey, length(o_custkey::varchar)::int) IN (SELECT source_id, instance FROM ids WHERE label IN ('west','mixed'))""")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("source_id"), F.length(F.col("o_custkey").cast("string")).alias("instance"))
    return K.restrict(o, _label_ids(t).where("label IN ('west', 'mixed')"), ["source_id", "instance"]).select("o_orderkey")


@query("code_arrays", """
    WITH m AS (SELECT DISTINCT s_nationkey AS id, 'N'||c_nationkey AS code, n_name AS name FROM supplier JOIN nation s ON s.n_nationkey=s_nationkey JOIN customer ON c_nationkey=s_nationkey OR c_nationkey=s_nationkey+1 JOIN nation n ON n.n_nationkey=c_nationkey)
    SELECT id, string_agg(code,',' ORDER BY code) AS codes, string_agg(name,',' ORDER BY code) AS names FROM m GROUP BY 1""".replace("n_name AS name", "n.n_name AS name"))
def _(t):
    concept, *_ = _vocabulary(t)
    used = t.customer.select("c_nationkey").distinct()
    sup = t.supplier.select("s_nationkey").distinct()
    pairs = sup.select("s_nationkey", F.explode(F.array(F.col("s_nationkey"), F.col("s_nationkey") + 1)).alias("c_nationkey")).join(used, "c_nationkey", "left_semi")
    id_map = pairs.select(F.col("s_nationkey").alias("value"), F.lit(0).alias("instance"), F.concat(F.lit("GEO#N"), "c_nationkey").alias("concept"))
    r = K.code_arrays(sup.select(F.col("s_nationkey").alias("source_id"), F.lit(0).alias("instance")), id_map, concept, "GEO", "GEO")
    return r.select(F.col("source_id").alias("id"), F.array_join("codes", ",").alias("codes"), F.array_join("names", ",").alias("names"))


@query("concept_flags", LABELLED + """
    SELECT o_orderkey, """ + ", ".join(f"(o_custkey IN (SELECT source_id FROM ids WHERE label='{x}'))::int AS {x}" for x in ("west", "east", "mixed", "lost")) + " FROM orders")
def _(t):
    labels = ["west", "east", "mixed", "lost"]
    ids = _label_ids(t).select("label", F.col("source_id").alias("o_custkey"))
    r = K.add_flags(t.orders.select("o_orderkey", "o_custkey"), ids, ["o_custkey"], labels)
    return r.select("o_orderkey", *[F.col(x).cast("int").alias(x) for x in labels])


@query("concept_values", """
    SELECT event_id, CASE WHEN event_type IN ('click','view') THEN value END AS looking, CASE WHEN event_type='purchase' THEN value END AS buying FROM events""")
def _(t):
    reg = inline(t.spark, [("looking", "click"), ("looking", "view"), ("buying", "purchase")], "label string, code string")
    r = K.add_values(t.events.withColumn("codes", F.array("event_type", F.lit("none"))), reg, "codes", "value", ["looking", "buying"])
    return r.select("event_id", "looking", "buying")


@query("concept_text", """
    SELECT doc_id, CASE WHEN (contains(text,'the ') OR contains(text,' der ')) AND (contains(source,'src1') OR contains(source,'src7')) THEN n_chars END AS hit FROM documents""")
def _(t):
    r = K.add_text_concept(t.documents, {"text": ["the ", " der "], "source": ["src1", "src7"]}, "n_chars", "hit")
    return r.select("doc_id", "hit")


@query("concept_flags_wide", """
    SELECT l_orderkey, l_linenumber, (p_type IN ('PROMO','LARGE'))::int AS big, (p_type='SMALL')::int AS tiny, 0 AS nothing FROM lineitem JOIN part ON p_partkey=l_partkey""")
def _(t):
    wide = t.part.select(F.col("p_partkey").alias("l_partkey"), *[(F.col("p_type") == x).alias(f"T_{x}") for x in ("PROMO", "LARGE", "SMALL")])
    r = K.add_flags_wide(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), wide, {"big": ["PROMO", "LARGE"], "tiny": ["SMALL"], "nothing": ["NONE"]}, ["l_partkey"], "T_")
    return r.select("l_orderkey", "l_linenumber", *[F.col(x).cast("int").alias(x) for x in ("big", "tiny", "nothing")])


@query("id_label_map", LABELLED + """
    SELECT source_id, max((label='west')::int) AS west, max((label='east')::int) AS east, max((label='mixed')::int) AS mixed FROM ids GROUP BY 1""")
def _(t):
    r = K.label_map(_label_ids(t), ["west", "east", "mixed"], ["source_id"])
    return r.select("source_id", *[F.col(x).cast("int").alias(x) for x in ("west", "east", "mixed")])


@query("name_group_codes", """
    WITH c AS (SELECT p_partkey, p_name, regexp_replace(coalesce(nullif(p_brand,'Brand#11'), 'X'||p_type),'^X','') AS code FROM part)
    SELECT p_partkey, codes FROM c JOIN (SELECT p_name, string_agg(DISTINCT code,',' ORDER BY code) AS codes FROM c GROUP BY 1) USING (p_name)""")
def _(t):
    p = t.part.select("p_partkey", "p_name", F.expr("nullif(p_brand, 'Brand#11')").alias("code"), F.concat(F.lit("X"), "p_type").alias("fallback"))
    return K.harmonise_codes(p, "p_name", "code", "fallback").select("p_partkey", F.array_join("codes", ",").alias("codes"))


@query("cross_reference_ids", """
    SELECT o_orderkey, split_part(coalesce(CASE WHEN o_orderpriority='1-URGENT' THEN 'u'||o_custkey||'|x' END, CASE WHEN o_orderstatus='F' THEN 'f'||o_custkey END),'|',1) AS ref,
      o_orderstatus AS plain FROM orders""")
def _(t):
    o = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("u"), "o_custkey", F.lit("|x"))).alias("a"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("f"), "o_custkey")).alias("b"), F.col("o_orderstatus").alias("c"),
    )
    return K.xref_table(o, {"ref": ["a", "b"], "plain": ["c"]})
