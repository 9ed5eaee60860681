"""Window totals by running counts against a direct count."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import asof
from cohortry.operators import temporal as T

FIRST = dt.date(2020, 1, 1)


def day(k):
    return None if k is None else FIRST + dt.timedelta(k)


@pytest.fixture(scope="module")
def sample(spark):
    """A person with most rows, items that repeat on and between days, and windows that are null, inverted, one day long or open."""
    rng = random.Random(6)
    person = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    facts = [(person(), day(rng.choice([None, *range(200)])), rng.choice([None, *range(12)]), rng.choice(["F", "O", None])) for _ in range(900)]
    cohort = []
    for k in range(250):
        lo = rng.randrange(-5, 200)
        lo, hi = rng.choice([(lo, lo + rng.randrange(60)), (lo, lo), (lo, lo - 3), (lo, lo - 1), (None, lo), (lo, None), (lo, 2_000_000), (-700_000, lo), (-700_000, 2_900_000)])
        cohort.append((k, person(), day(lo), day(hi)))
    cohort.append((999, "nobody", day(0), day(99)))
    return spark.createDataFrame(facts, "p string, t date, item int, kind string"), spark.createDataFrame(cohort, "k int, p string, lo date, hi date"), facts, cohort


def inside(facts, p, lo, hi):
    return [f for f in facts if p is not None and f[0] == p and f[1] and lo and hi and lo <= f[1] <= hi]


def test_flags_and_totals(sample, rows):
    facts, cohort, plain, people = sample
    daily = facts.groupBy("p", F.col("t").alias("__day")).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("kind") == "F").cast("int")).alias("f"))
    got = asof.window_totals(cohort, daily, ["p"], F.col("lo"), F.col("hi"), {"n": "n"})
    assert rows(got.select("k", "n")) == sorted(((k, len(inside(plain, p, lo, hi))) for k, p, lo, hi in people), key=repr)
    marked = facts.withColumns({"f": F.col("kind") == "F", "o": F.col("kind") == "O"})
    got = T.flag_in_window(cohort, [marked, marked.where("item = 3")], ["p"], "t", F.col("lo"), F.col("hi"), ["f", "o"], "x_")
    want = [(k, *(int(any(f[3] == c for f in inside(plain, p, lo, hi))) for c in "FO")) for k, p, lo, hi in people]
    assert rows(got.select("k", "x_f", "x_o")) == sorted(want, key=repr)


@pytest.mark.parametrize("form", [T.window_item_counts, T.wide_window_item_counts])
def test_distinct_items(sample, rows, form):
    facts, cohort, plain, people = sample
    got = form(cohort, facts, ["p"], "t", F.col("lo"), F.col("hi"), "item", ("kind", ["F", "O"]), name="m")
    want = []
    for k, p, lo, hi in people:
        seen = inside(plain, p, lo, hi)
        want.append((k, *(len({f[2] for f in seen if f[2] is not None and kind in (None, f[3])}) for kind in (None, "F", "O"))))
    assert rows(got.select("k", "m", "m_F", "m_O")) == sorted(want, key=repr)
    assert set(got.columns) == {*cohort.columns, "m", "m_F", "m_O"}


def test_two_keys_and_no_rows(frame, rows):
    facts = frame([("a", 1, day(3), "x"), ("a", 2, day(3), "y")], "p string, i int, t date, item string")
    cohort = frame([("a", 1, day(0), day(9)), ("a", 3, day(0), day(9))], "p string, i int, lo date, hi date")
    counted = lambda c, f: T.wide_window_item_counts(c, f, ["p", "i"], "t", F.col("lo"), F.col("hi"), "item").select("p", "i", "n_items")
    assert rows(counted(cohort, facts)) == [("a", 1, 1), ("a", 3, 0)]
    assert rows(counted(cohort, facts.limit(0))) == [("a", 1, 0), ("a", 3, 0)]
    assert rows(counted(cohort.limit(0), facts)) == []


@pytest.mark.parametrize("first, last", [(0, 0), (1, 1), (1, 6), (5, 1000), (737_000, 737_120), (0, 3_652_059)])
def test_stretches_cover_a_window_once(spark, first, last):
    made = spark.range(1).select(asof._stretches(F.lit(first), F.lit(last)).alias("s")).first()["s"]
    parts = sorted((n << j, (n + 1) << j) for j, n in made)
    assert parts[0][0] == first and parts[-1][1] == last + 1
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and len(parts) <= 2 * asof.LEVELS


def test_no_copies_into_cells(sample):
    """Flags need no generated rows but the two ends of each window."""
    facts, cohort, _, _ = sample
    plan = T.flag_in_window(cohort, facts.withColumn("f", F.lit(1)), ["p"], "t", F.col("lo"), F.col("hi"), ["f"])._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "Expand" not in plan


def test_flags_take_one_read(sample):
    """The windows are joined once, to the last flagged day up to their end, and nothing is combined again after the days."""
    facts, cohort, _, _ = sample
    plan = T.flag_in_window(cohort, facts.withColumn("f", F.lit(1)), ["p"], "t", F.col("lo"), F.col("hi"), ["f"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 2


def test_totals_scan_the_days_as_they_are(sample):
    """Days and window ends are unique already: the scan has no aggregate of its own over their union."""
    facts, cohort, _, _ = sample
    daily = facts.groupBy("p", F.col("t").alias("__day")).agg(F.count(F.lit(1)).alias("n"))
    plan = asof.window_totals(cohort, daily, ["p"], F.col("lo"), F.col("hi"), {"n": "n"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Union")].split("Window")[1]
