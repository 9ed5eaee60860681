"""Table profiling: value frequencies and per-field statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.aggregate import require_columns
from cohortry.operators.scan import rank_rows


def field_values(tables: dict[str, tuple[DataFrame, list]], instance: str | None = None, where=None) -> DataFrame:
    """Frequencies of the values of fields (or field pairs), numbered in value order per table and field.

    Result: row_id, table_name, field_name, field_value, secondary_field_name, secondary_field_value, instance, value_count.
    """
    out = []
    for table, (df, fields) in tables.items():
        rows = df if where is None else df.where(where)
        for f in fields:
            pair = [f] if isinstance(f, str) else list(f)[:2]
            by = list(dict.fromkeys([*pair, *([instance] if instance and instance in df.columns else [])]))
            require_columns(df, by)
            counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("value_count"))
            numbered = rank_rows(counts, [], by, "row_id")
            second = pair[1] if len(pair) > 1 else None
            out.append(numbered.select(
                "row_id", F.lit(table).alias("table_name"), F.lit(pair[0]).alias("field_name"), F.col(pair[0]).cast("string").alias("field_value"),
                F.lit(second or "").alias("secondary_field_name"), (F.col(second).cast("string") if second else F.lit("")).alias("secondary_field_value"),
                (F.col(instance).cast("int") if instance in by else F.lit(None).cast("int")).alias("instance"), "value_count",
            ))
    return reduce(DataFrame.unionByName, out)


def table_profile(df: DataFrame, name: str, instance: str | None = None, approx: bool = False) -> DataFrame:
    """Per field: records, type, distinct values, distinct values per instance, nulls.

    One job with a branch per field, and each branch reads its own column only. Values are counted before the shuffle and spread
    by value, so a field with few or very many values is no hot spot. Long texts and nested values travel as digests.
    ``approx`` replaces exact distinct counts by sketches in a single aggregate over one scan.
    """
    per_instance = instance is not None and instance in df.columns
    none = F.lit(None).cast("long")

    def value(c, kind):
        if kind == "string":
            return F.when(F.length(c) > 64, F.sha2(F.col(c), 256)).otherwise(F.col(c))
        return F.sha2(F.to_json(F.struct(c)), 256) if kind.startswith(("array", "map", "struct")) else F.col(c)

    def missing(c):
        return F.count(F.when(F.col(c).isNull(), 1))

    if approx:
        stats, rows = [F.count(F.lit(1)).alias("n")], []
        for i, (c, kind) in enumerate(df.dtypes):
            pair = F.when(F.col(c).isNotNull() & F.col(instance).isNotNull(), F.struct(instance, value(c, kind))) if per_instance else None
            stats += [F.approx_count_distinct(value(c, kind)).alias(f"u{i}"), missing(c).alias(f"z{i}")]
            stats += [F.approx_count_distinct(pair).alias(f"p{i}")] if per_instance else []
            rows.append(F.struct(
                F.lit(name).alias("table_name"), F.col("n").alias("records_cnt"), F.lit(c).alias("field_name"), F.lit(kind).alias("data_type"),
                F.col(f"u{i}").alias("unique_cnt"), (F.col(f"p{i}") if per_instance else none).alias("instance_unique_cnt"), F.col(f"z{i}").alias("null_cnt"),
            ))
        return df.agg(*stats).select(F.inline(F.array(*rows)))

    def branch(c, kind):
        known, n = F.col("v").isNotNull(), F.count(F.lit(1)).alias("n")
        # The null flag is kept apart: to_json of a null struct field is not null.
        v = F.when(F.col(c).isNotNull(), value(c, kind)).alias("v")
        if per_instance:
            pairs = df.select(v, F.col(instance).alias("i")).groupBy("v", "i").agg(n)
            values = pairs.groupBy("v").agg(F.sum("n").alias("n"), F.count(F.when(known, F.col("i"))).alias("pairs"))
        else:
            values = df.select(v).groupBy("v").agg(n)
        s = values.agg(
            F.sum("n").alias("records_cnt"), F.count("v").alias("unique_cnt"), (F.sum("pairs") if per_instance else F.max(none)).alias("instance_unique_cnt"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_cnt"),
        )
        return s.select(
            F.lit(name).alias("table_name"), F.coalesce("records_cnt", F.lit(0)).alias("records_cnt"), F.lit(c).alias("field_name"),
            F.lit(kind).alias("data_type"), "unique_cnt", "instance_unique_cnt", "null_cnt",
        )

    return reduce(DataFrame.unionByName, [branch(c, kind) for c, kind in df.dtypes])
