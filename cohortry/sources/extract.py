"""Cohort-scoped extraction: cohort → base table → optional table → lookups, in one chain of left joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalars import age_at
from cohortry.operators.aggregate import require_columns
from cohortry.operators.concepts import add_flags


@dataclass(frozen=True)
class Part:
    """A table to attach: the frame, its join keys and the columns to take as ``{new: old}`` (None = all)."""

    table: DataFrame
    keys: list[str]
    columns: dict[str, str] | None = None
    omit: tuple[str, ...] = ()

    def frame(self) -> DataFrame:
        if self.columns is None:
            return self.table
        return self.table.select(*self.keys, *[F.col(old).alias(new) for new, old in self.columns.items() if new not in self.keys])


@dataclass(frozen=True)
class ExtractSpec:
    """How to extract one subject area.

    ``options`` are extra tables the caller may choose with ``join=``; ``lookups`` are always attached last.
    ``age`` names (event date, birth date, new column); it is added when the cohort carries the birth date.
    """

    base: Part
    options: dict[str, Part] = field(default_factory=dict)
    lookups: tuple[Part, ...] = ()
    age: tuple[str, str, str] | None = None

    def default_omit(self, tables: list[str] = ()) -> list[str]:
        """Columns left out by default: those of the base, the lookups and the chosen options, without repeats."""
        unknown = [t for t in tables if t not in self.options]
        if unknown:
            raise ValueError(f"unknown options: {unknown}; one of {sorted(self.options)}")
        parts = [self.base, *self.lookups, *[self.options[t] for t in tables]]
        return list(dict.fromkeys(c for p in parts for c in p.omit))


def extract(
    cohort: DataFrame | None, spec: ExtractSpec, keep: list[str] | None = None, join: list[str] | str | None = None,
    where=None, omit: list[str] | None = None, concepts: tuple[Callable[[DataFrame], DataFrame], ...] = (),
) -> DataFrame:
    """Records of a subject area for a cohort (or all records without one).

    ``keep`` lists cohort columns besides the keys (default all). ``where`` is applied to the joined row, so
    a null-rejecting filter turns the left joins into inner ones. ``concepts`` add columns before the filter.
    """
    chosen = [join] if isinstance(join, str) else list(join or [])
    default = spec.default_omit(chosen)
    out = spec.base.frame()
    if cohort is not None:
        require_columns(cohort, [*spec.base.keys, *(keep or [])])
        extra = [c for c in (cohort.columns if keep is None else keep) if c not in spec.base.keys]
        clash = [c for c in extra if c in out.columns]
        out = cohort.select(*spec.base.keys, *extra).join(out.drop(*clash), spec.base.keys, "left")
    for p in [*[spec.options[name] for name in chosen], *spec.lookups]:
        frame = p.frame()
        out = out.join(frame.drop(*[c for c in frame.columns if c in out.columns and c not in p.keys]), p.keys, "left")
    if spec.age is not None and spec.age[1] in out.columns:
        event, birth, name = spec.age
        out = out.withColumn(name, age_at(F.col(event), F.col(birth)))
    for add in concepts:
        out = add(out)
    if where is not None:
        out = out.where(where)
    return out.drop(*(default if omit is None else omit))


def person_cohort(
    person: DataFrame, attrs: DataFrame, keys: list[str], collect: str, omit=(), where=None,
) -> DataFrame:
    """One row per person with the sorted set of an attribute (such as race) from a 1-to-many table."""
    sets = attrs.groupBy(*keys).agg(F.sort_array(F.collect_set(collect)).alias(collect))
    out = person.join(sets, keys, "left")
    return (out if where is None else out.where(where)).drop(*omit)


def snapshot(cohort: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Every cohort row with all its fact rows (nulls where none), ready to be saved as a table."""
    return cohort.join(facts, keys, "left")


def flagged_facts(
    cohort: DataFrame, facts: DataFrame, keys: list[str], id_map: DataFrame, on: list[str], labels: list[str],
    where=None, ids_array: str | None = None,
) -> DataFrame:
    """Facts carrying a mapped concept, right-joined to the cohort with one flag per label.

    ``ids_array`` names an array column of ids to explode first. ``where`` filters facts before they are projected.
    """
    rows = facts if ids_array is None else facts.withColumn(on[0], F.explode(ids_array)).drop(ids_array)
    if where is not None:
        rows = rows.where(where)
    mapped = id_map.where(F.col("label").isin(labels))
    hits = add_flags(rows.join(mapped.select(*on).distinct(), on, "left_semi"), mapped, on, labels)
    return hits.join(cohort, keys, "right")
