"""Cohort builders: linked episodes, index and prior events, dose series, insurance, exposure, notes, geography."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.clinical import TERM_DAYS, gestation_category, period, result_category_agg, result_short
from cohortry.functions.scalars import all_in, any_within, any_without, phrase_tier, recode_map, regex_first
from cohortry.operators.aggregate import dedupe
from cohortry.operators.filters import eligible, null_if
from cohortry.operators.joins import join
from cohortry.operators.temporal import _attach, _in_window, _windows, event_after, flag_in_window
from cohortry.session import checkpoint


# Actions by which a dose was not administered.
NOT_GIVEN = ["Canceled Entry", "Held", "Missed", "Automatically Held", "Held by Provider", "MAR Hold", "Stopped", "Paused"]


def parent_child_cohort(
    episodes: DataFrame, keys: list[str], episode: str, parent: str, delivery: str, due: str, keep: list[str] = (), term: int = TERM_DAYS,
) -> DataFrame:
    """Child episodes linked to their parent episode, with length of gestation, its category and start date.

    ``gestational_days = term + (delivery − due)``, with the delivery date of the child and the due date of the parent.
    """
    parents = episodes.select(*keys, F.col(episode).alias("__parent"), F.col(due).alias("due_date"))
    kids = episodes.where(F.col(parent).isNotNull()).select(*keys, F.col(episode).alias("child_episode_id"), F.col(parent).alias("__parent"), F.col(delivery).alias("delivery_date"), *keep)
    days = F.lit(term) + F.datediff("delivery_date", "due_date")
    out = kids.join(parents, [*keys, "__parent"]).withColumnRenamed("__parent", "episode_id").withColumn("gestational_days", days)
    return out.withColumns({
        "gestation_category": gestation_category(F.col("gestational_days")),
        "start_date": F.date_sub("delivery_date", F.col("gestational_days")),
    })


def tested_cohort(results: DataFrame, by: list[str], ts: str, text: str, phrases=None) -> DataFrame:
    """Per person: result category, number of tests, first test, first positive test. No lists are built."""
    short = results.withColumn("__r", result_short(F.col(text), phrases))
    return short.groupBy(*by).agg(
        result_category_agg(F.col("__r")).alias("result_category"),
        F.count(F.lit(1)).alias("n_tests"),
        F.min(ts).alias("first_test"),
        F.min(F.when(F.col("__r") == "positive", F.col(ts))).alias("first_positive"),
    )


def eligible_join(a: DataFrame, b: DataFrame, keys: list[str], criteria: list) -> DataFrame:
    """Inner join on the keys, then every criterion."""
    return eligible(join(a, b, keys), criteria)


def index_event(
    cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, pred: Column, start: str, end: str, cutoff=None, term: int = TERM_DAYS,
) -> DataFrame:
    """Cohort rows with their first fact meeting ``pred`` on a day from ``start`` to ``end``: index_date and index_day.

    With a ``cutoff``, only rows whose projected term date (start + term) lies before it can have an index.
    """
    rows = cohort if cutoff is None else cohort.where(F.date_add(F.to_date(start), term) < F.lit(cutoff).cast("date"))
    daily = facts.where(pred).groupBy(*keys, F.to_date(t).alias("__day")).agg(F.min(t).alias("__t"))
    windows = _windows(rows, keys, F.col(start), F.col(end))
    found = _in_window(windows, daily, keys).groupBy(*keys, "__lo", "__hi").agg(F.min("__t").alias("index_date"))
    out = _attach(windows, found, keys, {}).where(F.col("index_date").isNotNull())
    return out.withColumn("index_day", F.datediff("index_date", start))


def prior_event(cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, pred: Column, before: str, name: str = "prior") -> DataFrame:
    """Flag and date of the first fact meeting ``pred``, if it lies strictly before the row's date."""
    first = facts.where(pred).groupBy(*keys).agg(F.min(t).alias("__first"))
    date = F.when(F.col("__first") < F.col(before), F.col("__first"))
    return cohort.join(first, keys, "left").withColumns({name: date.isNotNull().cast("int"), f"{name}_date": date}).drop("__first")


def split_counts(df: DataFrame, stage: str, where=None) -> DataFrame:
    """Rows per stage, optionally for a restriction."""
    return (df if where is None else df.where(where)).groupBy(stage).agg(F.count(F.lit(1)).alias("n"))


def event_after_end(cohort: DataFrame, facts: DataFrame, keys: list[str], t: str, end: str, days: int = 42) -> DataFrame:
    """Cohort rows with a fact 1 … ``days`` days after their end date."""
    hits = facts.select(*keys, t, F.lit(1).alias("__hit"))
    flagged = flag_in_window(cohort, hits, keys, t, F.date_add(F.col(end), 1), F.date_add(F.col(end), days), ["__hit"])
    return flagged.where("__hit = 1").drop("__hit")


def series_complete(ledger: DataFrame, rules: list[tuple[str, str, int]], delay: int = 14, until: str | None = None) -> DataFrame:
    """Completed dose series of each ledger row: product and completion date (null where none).

    A rule is (product, LIKE pattern, doses): with 1 dose the first entry must match and completes after ``delay`` days, if the last
    entry is of the same label or the second one comes after the date in ``until``; with 2, the first two entries (distinct days) must match and the second one counts. The first rule met wins.
    """
    product, date = F.lit(None).cast("string"), F.lit(None).cast("date")
    entry = [F.try_element_at("entries", F.lit(i)) for i in (1, 2)]
    later = F.coalesce(entry[1]["date"] > F.to_date(until), F.lit(False)) if until else F.lit(False)
    unmixed = (F.try_element_at("entries", F.lit(-1))["label"] == entry[0]["label"]) | later
    for name, pattern, doses in reversed(rules):
        met = reduce(lambda a, b: a & b, [entry[i]["label"].like(pattern) for i in range(doses)])
        met = met & unmixed if doses == 1 else met
        product = F.when(met, name).otherwise(product)
        date = F.when(met, F.date_add(entry[doses - 1]["date"], delay)).otherwise(date)
    return ledger.withColumns({"product": product, "complete_date": date})


def breakthrough(cohort: DataFrame, series: DataFrame, keys: list[str], index: str, gap: int = 0, prior: str | None = None) -> DataFrame:
    """Cohort rows whose series was complete (plus ``gap`` days) before the index, without prior immunity."""
    done = series.where(F.col("complete_date").isNotNull()).select(*keys, "product", "complete_date")
    out = cohort.join(done, keys).where(F.date_add("complete_date", gap) < F.to_date(index))
    return out if prior is None else out.where(F.coalesce(prior, F.lit(0)) == 0)


def not_yet(cohort: DataFrame, ledger: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """Cohort rows whose first entry comes after the anchor, or who have none."""
    first = ledger.select(*keys, F.col("first_date").alias("__first"))
    return cohort.join(first, keys, "left").where(F.col("__first").isNull() | (F.col("__first") > F.to_date(anchor))).drop("__first")


def boosters(cohort: DataFrame, ledger: DataFrame, keys: list[str], anchor: str, gap_days: int = 168, delay: int = 14) -> DataFrame:
    """Cohort rows with booster date, days since the second entry, and status at the anchor.

    The booster is the third distinct date, when it lies before the anchor. ``booster_late`` tells whether it also lies more than
    ``gap_days`` after the completed series, ``delay`` days after the second date.
    """
    second, third = [F.try_element_at("entries", F.lit(i))["date"] for i in (2, 3)]
    steps = ledger.select(*keys, second.alias("__second"), third.alias("__third"))
    gap = F.datediff("__third", "__second")
    boosted = F.coalesce(F.col("__third") < F.to_date(anchor), F.lit(False))
    return cohort.join(steps, keys, "left").withColumns({
        "booster_date": F.when(boosted, F.col("__third")), "booster_gap": F.when(boosted, gap), "boosted": boosted.cast("int"),
        "booster_late": (boosted & F.coalesce(gap > gap_days + delay, F.lit(False))).cast("int"),
    }).drop("__second", "__third")


def maintained(cohort: DataFrame, ledger: DataFrame, keys: list[str], anchor: str, months: int = 6) -> DataFrame:
    """Cohort rows with an entry d such that d < anchor < d + months."""
    dates = ledger.select(*keys, F.col("entries.date").alias("__dates"))
    return cohort.join(dates, keys).where(any_within(F.col("__dates"), F.to_date(anchor), months)).drop("__dates")


def era_counts(df: DataFrame, date: str, periods: list[tuple[str, str, str]], flag: str) -> DataFrame:
    """Rows and flagged rows per period; rows outside all periods are counted under null."""
    return df.withColumn("era", period(F.to_date(date), periods)).groupBy("era").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(flag).cast("int"), F.lit(0))).alias("n_flag")
    )


def payor(
    chain: DataFrame, keys: list[str], payor_col: str, class_col: str, rules: list[tuple[list[str], str]], otherwise: str,
    class_map: dict[str, str], priority: list[str], class_synonyms: dict[str, str] | None = None,
) -> DataFrame:
    """One insurance class per person.

    Payor text decides by phrase tier (``otherwise`` if none matches); without a payor the financial class counts, after synonyms.
    ``class_map`` folds classes into the names of ``priority``; the earliest name in it wins.
    """
    own = recode_map(F.col(class_col), class_synonyms, None) if class_synonyms else F.lit(None).cast("string")
    named = F.when(F.col(payor_col).isNull(), F.coalesce(own, F.col(class_col))).otherwise(
        F.coalesce(phrase_tier(F.col(payor_col), rules), F.lit(otherwise))
    )
    folded = recode_map(named, class_map)
    rank = recode_map(folded, {name: i for i, name in enumerate(priority)})
    ranked = chain.select(*keys, folded.alias("insurance"), rank.alias("__rank")).where(F.col("__rank").isNotNull())
    return ranked.groupBy(*keys).agg(F.min_by("insurance", "__rank").alias("insurance"))


def exposure(
    daily: DataFrame, keys: list[str], t: str, names: str, excluded: list[str], keywords: list[str],
    lo: str | None = None, hi: str | None = None, level: tuple[str, object] | None = None,
    actions: str | None = None, not_given: list[str] = NOT_GIVEN,
) -> DataFrame:
    """First exposed day per key: every name with a keyword, not all names excluded, inside the row's span, at the given level.

    ``names`` is an array column of what was given that day, ``actions`` one of what was done; a day on which nothing but
    ``not_given`` was done does not count.
    """
    listed = F.col(names)
    rows = daily.where(~any_without(listed, keywords) & ~((F.size(listed) > 0) & all_in(listed, excluded)))
    if actions is not None:
        rows = rows.where((F.size(actions) == 0) | ~all_in(F.col(actions), not_given))
    if lo is not None:
        rows = rows.where(F.col(t) >= F.col(lo))
    if hi is not None:
        rows = rows.where(F.col(t) <= F.col(hi))
    if level is not None:
        rows = rows.where(F.col(level[0]) == level[1])
    return dedupe(rows, keys, t)


def any_yes(cohort: DataFrame, facts: DataFrame, keys: list[str], cols: list[str], yes: str = "Yes") -> DataFrame:
    """1 per column if any record of the person says yes, else 0."""
    flags = facts.groupBy(*keys).agg(*[F.max((F.col(c) == yes).cast("int")).alias(c) for c in cols])
    return cohort.join(flags, keys, "left").na.fill(0, cols)


# The obstetric history notations looked for in notes, in order of preference.
HISTORY_PATTERNS = [r"G\d{1}P\d{4}", r"G\d{1}\s+P\d{1}\s+T\d{1}\s+P\d{1}\s+A\d{1}", r"G\d{1}P\d{1}", r"G\d{1}\s{1}P\d{1}"]


def history_digits(code: Column) -> dict[str, Column]:
    """Gravidity, parity and preterm digits of a history notation."""
    def pick(pattern, group=1):
        return F.nullif(F.regexp_extract(code, pattern, group), F.lit(""))

    return {
        "gravidity": pick(r"G(\d)"),
        "parity": pick(r"P(\d)"),
        # second digit of a four-digit block, or the second P of the long notation
        "preterm": F.coalesce(pick(r"P\d(\d)\d\d"), pick(r"P\d\D+.*?P(\d)")),
    }


def note_history(
    cohort: DataFrame, notes: DataFrame, keys: list[str], t: str, text: str, lo: Column, hi: Column,
    patterns: list[str] | None = None, digits=history_digits,
) -> DataFrame:
    """Largest notation found in the notes of [lo, hi] per cohort row, split into digits (0 where absent).

    The pattern is read from the whole text at the scan, so texts are never shuffled.
    """
    found = notes.select(*keys, F.to_date(t).alias("__day"), regex_first(F.col(text), patterns or HISTORY_PATTERNS).alias("code"))
    daily = found.where(F.col("code").isNotNull()).groupBy(*keys, "__day").agg(F.max("code").alias("code"))
    windows = _windows(cohort, keys, lo, hi)
    best = _in_window(windows, daily, keys).groupBy(*keys, "__lo", "__hi").agg(F.max("code").alias("code"))
    out = _attach(windows, best, keys, {})
    return out.withColumns({n: F.coalesce(c.cast("int"), F.lit(0)) for n, c in digits(F.col("code")).items()})


def attach_geo(
    cohort: DataFrame, person: DataFrame, geo: DataFrame, keys: list[str], area: Column, geo_key: str, sentinel=None,
) -> DataFrame:
    """Area measures on the cohort: derive the area key per person, look it up, turn the sentinel into null."""
    placed = person.select(*keys, area.cast("string").alias("__area"))
    measures = [c for c in geo.columns if c != geo_key]
    table = geo.select(F.col(geo_key).cast("string").alias("__area"), *measures)
    if sentinel is not None:
        table = null_if(table, measures, sentinel)
    return cohort.join(placed.join(table, "__area").drop("__area"), keys, "left")


def death_within(cohort: DataFrame, deaths: DataFrame, keys: list[str], index: str, t: str, months: int = 3) -> DataFrame:
    """Deaths within ``months`` after the index, cohort kept whole."""
    return event_after(cohort, deaths, keys, index, t, months, name="death")


def staged(df: DataFrame, steps: list, checkpoint_every: int = 0) -> DataFrame:
    """Apply enrichment steps (frame → frame) in order, cutting lineage after every n-th step if asked."""
    for i, step in enumerate(steps, 1):
        df = step(df)
        if checkpoint_every and i % checkpoint_every == 0:
            df = checkpoint(df)
    return df
