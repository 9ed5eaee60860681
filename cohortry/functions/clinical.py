"""Classification expressions over results, dates, gestation, severity and demographic codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.scalars import clean_string, phrase_exact

# Result phrases after cleaning, day and weight cut points. They decide the published categories.
POSITIVE = ["positive", "detected", "presumptive pos", "detected see scanned report", "detcted", "presumptive positive"]
NEGATIVE = [
    "none detected", "undetected", "not dectected", "negative", "not detected", "not deteced", "not detected see scanned result",
    "not detectd", "not detected see scanned report", "negatiev", "not detected see media", "non detected", "not dtected",
    "not detected see scanned results", "not detecte",
]
SEE_REPORT = [
    "see scanned report", "comment", "see scanned result", "abnormal see scanned report", "see report", "see scanned results",
    "see comments", "see scanned report covid19", "see comment", "please see scanned report", "see note", "separate report to follow",
    "see attached report", "refer to separate reference lab report for results",
]
STAGE_CUTS = (90, 181)
GESTATION_CUTS = (259, 238, 224, 196)
LOW_WEIGHT_OZ, VERY_LOW_WEIGHT_OZ = 88.1849, 52.91094
TERM_DAYS = 280


def result_short(c: Column, phrases: list[tuple[list[str], str]] | None = None, default: str = "unknown") -> Column:
    """Free-text result to positive / negative / see report or comment / unknown, by exact cleaned phrase."""
    tiers = phrases or [(POSITIVE, "positive"), (NEGATIVE, "negative"), (SEE_REPORT, "see report or comment")]
    return phrase_exact(clean_string(c), tiers, default)


def _category(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive, ">= 1 positive").when(negative, ">= 1 negative (no positive)").otherwise("inconclusive or unknown")
    )


def result_category(a: Column) -> Column:
    """Category of an array of short results."""
    a = F.coalesce(a, F.array().cast("array<string>"))
    return _category(F.array_contains(a, "positive"), F.array_contains(a, "negative"))


def result_category_agg(c: Column) -> Column:
    """The same category as an aggregate over rows, so the results of a person are never collected."""
    return _category(F.max(F.coalesce(c == "positive", F.lit(False))), F.max(F.coalesce(c == "negative", F.lit(False))))


def stage(days: Column, cuts=STAGE_CUTS, names=("1st trimester", "2nd trimester", "3rd trimester")) -> Column:
    """Stage of an index day: up to cuts[0], up to cuts[1], later."""
    return F.when(days <= cuts[0], names[0]).when(days <= cuts[1], names[1]).when(days.isNotNull(), names[2])


def gestation_category(days: Column, cuts=GESTATION_CUTS, names=("term", "late_preterm", "moderate_preterm", "very_preterm", "extremely_preterm")) -> Column:
    """Category by descending day thresholds; below the last one is the final name."""
    out = F.when(days >= cuts[0], names[0])
    for cut, name in zip(cuts[1:], names[1:]):
        out = out.when(days >= cut, name)
    return out.when(days.isNotNull(), names[len(cuts)])


def offset_with_fallback(t: Column, refs: list[tuple[Column, int]]) -> Column:
    """Day of ``t`` on a common axis from the first non-null reference; each reference lies on its own axis day."""
    return F.coalesce(*[F.datediff(t, ref) + F.lit(axis_day) for ref, axis_day in refs])


def adjusted_score(nominal: Column, supports: list[Column], disposition: Column, top: int = 8, base: int = 6) -> Column:
    """``top`` on an expired disposition, ``base + 1`` for ``base`` with any support, else the nominal score."""
    any_support = reduce(lambda a, b: a | b, [F.coalesce(s.cast("boolean"), F.lit(False)) for s in supports])
    expired = F.contains(F.lower(F.coalesce(disposition, F.lit(""))), F.lit("expired"))
    return F.when(expired, top).when((nominal == base) & any_support, base + 1).otherwise(nominal)


def severity(dead: Column, severe: Column, moderate: Column, names=("Dead", "Severe", "Moderate", "Mild")) -> Column:
    """Worst applicable level; a null test does not apply."""
    off = F.lit(False)
    return (
        F.when(F.coalesce(dead, off), names[0]).when(F.coalesce(severe, off), names[1]).when(F.coalesce(moderate, off), names[2]).otherwise(names[3])
    )


# Feature encodings -------------------------------------------------------------------------------

def consolidate(a: Column, synonyms: dict[str, str], drop: list[str], other: str = "Other", unknown: str = "Unknown", multi: str = "Multiracial") -> Column:
    """One category from a set of answers: synonyms merged, non-answers dropped, ``other`` ignored beside a real answer."""
    same = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    real = F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.isin(drop))
    merged = F.array_distinct(F.transform(real, lambda x: F.coalesce(F.try_element_at(same, x), x)))
    named = F.array_remove(merged, other)
    return (
        F.when(F.size(merged) == 0, unknown)
        .when(F.size(merged) == 1, merged[0])
        .when(F.size(named) == 1, named[0])
        .otherwise(multi)
    )


def bin_code(c: Column, bounds: list[float], codes: list, default=None) -> Column:
    """Code of the first bound above the value (``codes[i]`` for c < bounds[i], last code from the last bound on)."""
    if len(codes) != len(bounds) + 1:
        raise ValueError("need one code more than bounds")
    out = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(default))
    for b, code in zip(bounds, codes):
        out = out.when(c < b, F.lit(code))
    return out.otherwise(F.lit(codes[-1]))


def period(c: Column, periods: list[tuple[str, str, str]]) -> Column:
    """Name of the half-open period [from, to) holding the date; null outside all of them."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(periods):
        out = F.when((c >= F.lit(lo).cast("date")) & (c < F.lit(hi).cast("date")), name).otherwise(out)
    return out


def preterm_history(count: Column, gestation_days: Column, term: int = 259) -> Column:
    """1 if an earlier preterm birth is recorded that the present one does not explain."""
    n = F.coalesce(count.cast("int"), F.lit(0))
    return F.when((n == 0) | ((n == 1) & (gestation_days < term)), 0).otherwise(1)


# Codes of the published encodings. Each entry is (upper bounds, codes, code for a missing value).
ENCODINGS = {
    "parity": ([2, 5], [0, 1, 2], 0),
    "gravidity": ([2, 6], [0, 1, 2], 0),
    "bmi": ([18.5, 25, 30, 35, 40], [0, 1, 2, 3, 4, -1], -1),
    "age": ([25, 30, 35, 40, 45], [0, 1, 2, 3, 4, -1], -1),
}
RURALITY = ([4, 7, 10, 99, 100], ["Metropolitan", "Micropolitan", "SmallTown", "Rural", "NotCoded", None])
RURALITY_RANK = {"Rural": 0, "SmallTown": 1, "Micropolitan": 2, "Metropolitan": 3}
VAGINAL = [
    "Vaginal, Spontaneous", "Vaginal, Vacuum (Extractor)", "Vaginal, Forceps", "Vaginal < 20 weeks", "Vaginal, Breech",
    "VBAC, Spontaneous", "Vaginal Birth after Cesarean Section", "Spontaneous Abortion",
]
CESAREAN = ["C-Section, Low Transverse", "C-Section, Low Vertical", "C-Section, Classical", "C-Section, Unspecified"]


def encode(c: Column, name: str) -> Column:
    """One of the published binned encodings: parity, gravidity, bmi or age."""
    bounds, codes, missing = ENCODINGS[name]
    return bin_code(c.try_cast("double"), bounds, codes, missing)


def rurality(code: Column) -> Column:
    """Area type of a commuting-area code; null for codes above 99 and between 99 and 100."""
    bounds, names = RURALITY
    known = (code < 99) | (code == 99)
    return F.when(known, bin_code(code, bounds, names))


def rurality_rank(kind: Column) -> Column:
    """0 (rural) to 3 (metropolitan), -1 otherwise."""
    return phrase_exact(kind, [([name], rank) for name, rank in RURALITY_RANK.items()], -1)


def delivery_method(c: Column) -> Column:
    """0 vaginal, 1 cesarean, -1 unknown."""
    return phrase_exact(c, [(VAGINAL, 0), (CESAREAN, 1)], -1)
