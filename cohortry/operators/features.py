"""Design matrices: one-hot encoding, scaling, median imputation, complete numeric rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalars import min_max
from cohortry.operators.aggregate import require_columns
from cohortry.operators.quantiles import exact_quantiles


def one_hot(df: DataFrame, col: str, levels: list | dict, drop: bool = True) -> DataFrame:
    """A 0/1 column per level; ``levels`` is a list (column ``<col>_<level>``) or {new name: level}."""
    require_columns(df, [col])
    names = levels if isinstance(levels, dict) else {f"{col}_{v}": v for v in levels}
    out = df.withColumns({n: F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for n, v in names.items()})
    return out.drop(col) if drop else out


@dataclass(frozen=True)
class MatrixSpec:
    """Row ids, plain columns, {column: levels} to one-hot, columns to scale to 0…1, and final renames {new: old}."""

    ids: list[str]
    numeric: list[str] = field(default_factory=list)
    categories: dict = field(default_factory=dict)
    scale: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)


def design_matrix(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Select, encode and scale as the spec says; all columns are checked before anything runs."""
    require_columns(df, [*spec.ids, *spec.numeric, *spec.categories, *spec.scale])
    out = df.select(*dict.fromkeys([*spec.ids, *spec.numeric, *spec.scale, *spec.categories]))
    for col, levels in spec.categories.items():
        out = one_hot(out, col, levels)
    if spec.scale:
        out = min_max(out, spec.scale)
    return out.withColumnsRenamed({old: new for new, old in spec.rename.items()})


def missing_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: rows, rows present, percent present, exact median."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in cols])
    rows = counts.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in cols])))
    return rows.join(exact_quantiles(df, [], cols, {"median": 0.5}), "column", "left").select(
        "column", "n", "present", F.round(100 * F.col("present") / F.col("n"), 1).alias("percent"), "median"
    )


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls with the exact median of the column; a column without values stays null."""
    medians = exact_quantiles(df, [], cols, {"m": 0.5})
    fill = medians.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"m{i}") for i, c in enumerate(cols)])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fill.getField(f"m{i}")) for i, c in enumerate(cols)})


def numeric_complete(df: DataFrame, cols: list[str], id_cols: list[str], name: str = "row_id") -> DataFrame:
    """Numeric columns (text that is no number becomes null), complete rows only, with a row id from the id columns."""
    values = df.select(F.concat_ws("|", *id_cols).alias(name), *[F.col(c).try_cast("double").alias(c) for c in cols])
    return values.na.drop(subset=cols)
