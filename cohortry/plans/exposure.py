"""Exposure profile: the end-to-end plan from anchored persons and dated facts to one feature row per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.concepts import add_flags
from cohortry.operators.temporal import in_windows
from cohortry.operators.timewin import aggregate_custom


def exposure_profile(
    anchors: DataFrame, facts: DataFrame, keys: list[str], index: str, t: str, item: str, measure: str,
    label_ids: DataFrame, labels: list[str], span: tuple[int, int], bounds: list[int],
) -> DataFrame:
    """Per anchored person: measure sums per index-relative window and a 0/1 status per concept label.

    One window join and one aggregate give both: the label flags are further measures of the windows, and a status is their greatest.
    Facts go to their window cell as they are; they need no sums of their own before it.
    """
    window = (F.date_add(F.col(index), span[0]), F.date_add(F.col(index), span[1]))
    named = facts.select(*keys, t, item, measure)
    near = add_flags(in_windows(anchors, named, keys, t, [window]), label_ids, [item], labels)
    marks = {f"__f{i}": F.col(x).cast("int") for i, x in enumerate(labels)}
    wide = aggregate_custom(near.withColumns(marks), keys, {measure: "sum", **dict.fromkeys(marks, "max")}, t, index, bounds, layout="wide")
    parts = range(len(bounds or [0]) + 1)
    status = [F.greatest(*[F.col(f"{m}_max_{b}") for b in parts]).alias(x) for m, x in zip(marks, labels, strict=True)]
    found = wide.select(*keys, *[f"{measure}_sum_{b}" for b in parts], *status)
    return anchors.join(found, keys, "left").na.fill(0, labels)
