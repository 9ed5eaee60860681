"""Vocabulary work: registries, code expansion, source ids, and concept columns on records.

A registry is a frame (label, code). N concept columns cost one join: ids are first reduced to
one row with the set of their labels, which is bounded by the number of labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalars import coalesce_first, strip_prefix
from cohortry.operators.aggregate import require_columns
from cohortry.session import checkpoint


def registry(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows of the wanted labels; an unknown label is an error."""
    chosen = df.where(F.col("label").isin(labels))
    known = {r[0] for r in chosen.select("label").distinct().collect()}
    unknown = [x for x in labels if x not in known]
    if unknown:
        raise ValueError(f"labels not in the registry: {unknown}")
    return chosen


def codes(reg: DataFrame, concept: DataFrame, vocabulary: str) -> DataFrame:
    """(label, code, concept_id, concept_name) in one vocabulary, without expansion; unknown codes keep null ids."""
    names = concept.where(F.col("vocabulary_id") == vocabulary).select(
        F.col("concept_code").alias("code"), "concept_id", "concept_name"
    )
    return reg.select("label", "code").distinct().join(names, "code", "left").select("label", "code", "concept_id", "concept_name")


def _expand(found: DataFrame, concept: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    reached = (
        found.select("label", F.col("concept_id").alias(source))
        .join(edges.select(source, target), source)
        .select("label", F.col(target).alias("concept_id"))
        .distinct()
        .join(concept.select("concept_id", F.col("concept_code").alias("code"), "concept_name"), "concept_id")
    )
    cols = ["label", "code", "concept_id", "concept_name"]
    return found.select(*cols).union(reached.select(*cols)).distinct()


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor_concept_id, descendant_concept_id) of all paths of one edge or more, from direct edges; a cycle reaches itself.

    Each round joins the pairs found last with all known ones, so path lengths double and a hierarchy of depth d takes about log2(d) rounds.
    Pairs are written after each round. Null ends are no edges; repeated edges count once.
    """
    pairs = edges.select(F.col(parent).alias("a"), F.col(child).alias("d")).where("a is not null and d is not null").distinct()
    known = fresh = checkpoint(pairs)
    while not fresh.isEmpty():
        onward = known.select(F.col("a").alias("d"), F.col("d").alias("to"))
        reached = fresh.join(onward, "d").select("a", F.col("to").alias("d")).distinct()
        fresh = checkpoint(reached.join(known, ["a", "d"], "left_anti"))
        known = known.union(fresh)
    return known.select(F.col("a").alias("ancestor_concept_id"), F.col("d").alias("descendant_concept_id"))


def expand_descendants(found: DataFrame, concept: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Codes plus all descendants through the ancestor closure."""
    return _expand(found, concept, ancestor, "ancestor_concept_id", "descendant_concept_id")


def expand_related(found: DataFrame, concept: DataFrame, relationship: DataFrame) -> DataFrame:
    """Codes plus directly related codes."""
    return _expand(found, concept, relationship, "concept_id_1", "concept_id_2")


def split_map(id_map: DataFrame, system: str, value: str = "value") -> DataFrame:
    """(source_id, instance, code) of one coding system from an id map with ``SYSTEM#code`` keys."""
    key = F.split("concept", "#")
    return id_map.where(key[0] == system).select(F.col(value).alias("source_id"), "instance", key[1].alias("code")).distinct()


def to_source_ids(found: DataFrame, id_map: DataFrame, system: str) -> DataFrame:
    """(label, source_id, instance) of all records ids mapped to a label's codes."""
    return found.select("label", "code").distinct().join(split_map(id_map, system), "code").select("label", "source_id", "instance").distinct()


def restrict(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Records whose id is among the concept's ids."""
    return df.join(ids.select(*on).distinct(), on, "left_semi")


def code_arrays(ids: DataFrame, id_map: DataFrame, concept: DataFrame, system: str, vocabulary: str) -> DataFrame:
    """Source id → arrays of its codes and names, both in code order."""
    names = concept.where(F.col("vocabulary_id") == vocabulary).select(F.col("concept_code").alias("code"), F.col("concept_name").alias("name"))
    pairs = split_map(id_map, system).join(ids.select("source_id", "instance").distinct(), ["source_id", "instance"], "left_semi")
    rows = pairs.join(names, "code").groupBy("source_id", "instance").agg(F.array_sort(F.collect_set(F.struct("code", "name"))).alias("r"))
    return rows.select("source_id", "instance", F.col("r.code").alias("codes"), F.col("r.name").alias("names"))


def add_flags(df: DataFrame, label_ids: DataFrame, on: list[str], labels: list[str]) -> DataFrame:
    """One true/false column per label (never null), through a single join on the id columns."""
    require_columns(df, on)
    sets = label_ids.where(F.col("label").isin(labels)).groupBy(*on).agg(F.collect_set("label").alias("__labels"))
    has = [F.coalesce(F.array_contains("__labels", x), F.lit(False)).alias(x) for x in labels]
    return df.join(sets, on, "left").select(*df.columns, *has)


def add_values(df: DataFrame, reg: DataFrame, code_col: str, value_col: str, labels: list[str]) -> DataFrame:
    """Per label: the record's value if any of its codes (array or scalar) belongs to the label, else null."""
    require_columns(df, [code_col, value_col])
    own = F.col(code_col) if dict(df.dtypes)[code_col].startswith("array") else F.array(code_col)
    # Labels are looked up once per distinct code list, with a join, so the registry may be of any size.
    lists = df.select(code_col).where(F.col(code_col).isNotNull()).distinct()
    wanted = reg.where(F.col("label").isin(labels)).select("label", F.col("code").alias("__code")).distinct()
    sets = lists.withColumn("__code", F.explode(own)).join(wanted, "__code").groupBy(code_col).agg(F.collect_set("label").alias("__labels"))
    return df.join(sets, code_col, "left").select(*df.columns, *[F.when(F.array_contains("__labels", x), F.col(value_col)).alias(x) for x in labels])


def text_concept(terms: dict[str, list[str]]) -> Column:
    """True if, in every field, at least one of its phrases occurs; a null field has none."""
    def occurs(name, phrases):
        return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(name), F.lit(p)), F.lit(False)) for p in phrases])

    return reduce(lambda a, b: a & b, [occurs(n, p) for n, p in terms.items()])


def add_text_concept(df: DataFrame, terms: dict[str, list[str]], value_col: str, name: str) -> DataFrame:
    """The record's value where its text fields match, else null."""
    require_columns(df, [*terms, value_col])
    return df.withColumn(name, F.when(text_concept(terms), F.col(value_col)))


def add_flags_wide(df: DataFrame, wide_map: DataFrame, labels: dict[str, list[str]], on: list[str], prefix: str = "") -> DataFrame:
    """Flags from a table with one boolean column per code; a label without any such column is false throughout."""
    def any_code(cs):
        present = [F.coalesce(F.col(prefix + c), F.lit(False)) for c in cs if prefix + c in wide_map.columns]
        return reduce(lambda a, b: a | b, present) if present else F.lit(False)

    flags = wide_map.groupBy(*on).agg(*[F.max(any_code(cs)).alias(x) for x, cs in labels.items()])
    return df.join(flags, on, "left").select(*df.columns, *[F.coalesce(x, F.lit(False)).alias(x) for x in labels])


def label_map(label_ids: DataFrame, labels: list[str], on: list[str]) -> DataFrame:
    """One row per id with a true/false column per label, to be stored and reused."""
    return label_ids.where(F.col("label").isin(labels)).groupBy(*on).agg(*[F.max(F.col("label") == x).alias(x) for x in labels])


def harmonise_codes(df: DataFrame, name: str, code: str, default: str, prefix: str = "X", out: str = "codes") -> DataFrame:
    """All codes seen under a record's name: own code or the default, marker stripped, as a sorted set on each row."""
    own = strip_prefix(F.coalesce(F.col(code), F.col(default)), prefix)
    sets = df.groupBy(name).agg(F.sort_array(F.collect_set(own)).alias(out))
    return df.join(sets, name, "left")


def xref_table(df: DataFrame, targets: dict[str, list[str]], delimiter: str = "|") -> DataFrame:
    """Per target id the first reference given: first non-null source column, first part of its list."""
    kept = [c for c in df.columns if not any(c in cols for cols in targets.values())]
    return df.select(*kept, *[coalesce_first([F.col(c) for c in cols], delimiter).alias(t) for t, cols in targets.items()])
