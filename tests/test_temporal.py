import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry.operators import cohorts as C
from cohortry.operators import temporal as T
from cohortry.operators import timewin as W

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


@pytest.fixture(scope="module")
def cohort(frame):
    return frame([("a", 1, D(100)), ("a", 2, D(200)), ("b", 3, D(100)), ("c", 4, None), (None, 5, D(1))], "p string, k int, i date")


@pytest.fixture(scope="module")
def facts(frame):
    return frame([("a", D(86), "x", True), ("a", D(85), "y", False), ("a", D(160), "x", None), ("a", D(161), "z", True), ("b", D(100), "x", True), (None, D(1), "x", True)], "p string, t date, item string, f boolean")


def test_window_flags_on_the_boundaries(cohort, facts, rows):
    r = T.flag_in_window(cohort, facts, ["p"], "t", F.date_sub("i", 14), F.date_add("i", 60), ["f"])
    assert rows(r.select("k", "f")) == [(1, 1), (2, 0), (3, 1), (4, 0), (5, 0)]
    late = facts.where("item = 'z'")  # 61 days after the first index, 39 before the second
    r = T.flag_in_window(cohort, late, ["p"], "t", F.date_sub("i", 39), F.date_add("i", 60), ["f"])
    assert rows(r.select("k", "f"))[:2] == [(1, 0), (2, 1)]
    r = T.active_status(cohort, facts.where("item = 'y'"), ["p"], "i", "t", 15, "act")
    assert rows(r.select("k", "act")) == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 0)]
    r = T.active_status(cohort, facts.where("item = 'y'"), ["p"], "i", "t", 14, "act")
    assert rows(r.select("k", "act"))[0] == (1, 0)


def test_counts_sets_and_sums(cohort, facts, rows):
    lo, hi = F.date_sub("i", 14), F.date_add("i", 61)
    assert rows(T.window_item_counts(cohort, facts, ["p"], "t", lo, hi, "item", ("item", ["x"])).select("k", "n_items", "n_items_x")) == [(1, 2, 1), (2, 0, 0), (3, 1, 1), (4, 0, 0), (5, 0, 0)]
    r = T.window_set(cohort, [facts, facts], ["p"], "t", lo, hi, "item")
    assert rows(r.select("k", "items_count", "items_list"))[:3] == [(1, 2, ["x", "z"]), (2, 0, None), (3, 1, ["x"])]
    one = facts.withColumn("v", F.lit(2))
    assert rows(T.window_sum(cohort, one, ["p"], "t", lo, hi, "v").select("k", "v_sum"))[:3] == [(1, 6, ), (2, 0), (3, 2)]


def test_exposed_and_unexposed_split_the_cohort(cohort, facts, rows):
    exposed = T.in_windows(cohort, facts, ["p"], "t", [(F.date_sub("i", 14), F.date_add("i", 60)), (F.col("i"), F.date_add("i", 60))])
    assert rows(exposed.select("k", "t")) == [(1, D(160)), (3, D(100))]
    rest = T.unexposed(cohort, exposed, ["k"], ["p"])
    assert rows(rest.select("k")) == [(4,), (5,)]


def test_event_after_with_and_without_lower_bound(cohort, frame, rows):
    deaths = frame([("a", D(150)), ("b", D(50))], "p string, t date")
    assert rows(T.event_after(cohort, deaths, ["p"], "i", "t", 3).select("k", "event")) == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 0)]
    assert rows(T.event_after(cohort, deaths, ["p"], "i", "t", 3, lower=False).select("k", "event"))[:3] == [(1, 1), (2, 1), (3, 1)]


def test_stays_overlap_and_clipping(cohort, frame, rows):
    stays = frame([("a", D(80), D(105)), ("a", D(113), D(120)), ("a", D(114), D(115)), ("a", D(90), None), ("b", D(120), D(90))], "p string, start date, stop date")
    r = T.overlap_or_near(cohort, stays, ["p"], "i", "start", "stop")
    assert rows(r.select("k", "start_offset", "end_offset")) == [(1, -20, 5), (1, 13, 20)]
    c = cohort.withColumn("until", F.date_add("i", 15))
    assert rows(T.clipped_days(c, stays, ["p"], "i", "until").select("p", "i", "days")) == [("a", D(100), 6 + 8 + 2)]
    late = cohort.withColumn("until", F.date_sub("i", 3))
    assert rows(T.clipped_days(late, stays, ["p"], "i", "until").select("p", "i", "days")) == [("a", D(100), 6)]


def test_onset_and_stays_from_events(frame, rows):
    df = frame([(D(10), D(4)), (D(10), D(5)), (D(10), None)], "i date, a date")
    assert [r.o for r in df.select(T.onset(F.col("i"), F.col("a")).alias("o")).collect()] == [D(10), D(5), None]
    e = frame([("a", "Admission", D(2)), ("a", "Transfer In", D(1)), ("a", "Discharge", D(5)), ("b", "Discharge", D(3))], "p string, k string, t date")
    assert rows(T.stays(e, ["p"], "k", "t", ["Admission", "Transfer In"], ["Discharge"])) == [("a", D(1), D(5)), ("b", None, D(3))]


def test_index_and_prior_events(frame, rows):
    cohort = frame([("a", D(0), D(270)), ("b", D(0), D(270)), ("c", D(300), D(570))], "p string, s date, e date")
    facts = frame([("a", D(-1), "pos"), ("a", D(90), "pos"), ("a", D(20), "neg"), ("b", D(271), "pos"), ("c", D(300), "pos")], "p string, t date, r string")
    hit = F.col("r") == "pos"
    assert rows(C.index_event(cohort, facts, ["p"], "t", hit, "s", "e").select("p", "index_day")) == [("a", 90), ("c", 0)]
    assert rows(C.index_event(cohort, facts, ["p"], "t", hit, "s", "e", cutoff=D(400)).select("p", "index_day")) == [("a", 90)]
    assert rows(C.prior_event(cohort, facts, ["p"], "t", hit, "s").select("p", "prior", "prior_date")) == [("a", 1, D(-1)), ("b", 0, None), ("c", 0, None)]


def test_dose_series_boosters_and_upkeep(frame, rows):
    doses = frame([("a", D(0), "ONE"), ("b", D(0), "TWO"), ("b", D(0), "TWO"), ("b", D(28), "TWO"), ("b", D(28 + 169), "ANY"), ("c", D(0), "TWO"), ("c", D(9), "ONE")], "p string, d date, v string")
    book = W.ledger(doses, ["p"], "d", "v")
    series = C.series_complete(book, [("single", "ONE%", 1), ("pair", "TWO%", 2)])
    assert rows(series.select("p", "product", "complete_date")) == [("a", "single", D(14)), ("b", "pair", D(42)), ("c", None, None)]
    people = frame([("a", D(15)), ("b", D(300)), ("c", D(8)), ("d", D(1))], "p string, i date")
    assert rows(C.breakthrough(people, series, ["p"], "i").select("p")) == [("a",), ("b",)]
    assert rows(C.not_yet(people, book, ["p"], "i").select("p")) == [("d",)]
    assert rows(C.boosters(people, book, ["p"], "i").select("p", "boosted", "booster_gap")) == [("a", 0, None), ("b", 1, 169), ("c", 0, None), ("d", 0, None)]
    assert rows(C.boosters(people, book, ["p"], "i", gap_days=154, delay=14).select("p", "boosted", "booster_late")) == [("a", 0, 0), ("b", 1, 1), ("c", 0, 0), ("d", 0, 0)]
    assert rows(C.boosters(people, book, ["p"], "i").select("booster_late")) == [(0,)] * 4
    mixed = W.ledger(frame([("a", D(0), "ONE"), ("a", D(30), "TWO"), ("b", D(0), "ONE"), ("b", D(30), "ONE")], "p string, d date, v string"), ["p"], "d", "v").withColumn("end", F.lit(D(20)))
    rule = [("single", "ONE%", 1)]
    assert rows(C.series_complete(mixed, rule).select("p", "product")) == [("a", None), ("b", "single")]
    assert rows(C.series_complete(mixed, rule, until="end").select("p", "product")) == [("a", "single"), ("b", "single")]
    assert rows(C.maintained(people, book, ["p"], "i").select("p")) == [("a",), ("b",), ("c",)]


def test_linked_episodes(frame, rows):
    e = frame([("p", "m1", None, None, D(280)), ("p", "c1", "m1", D(259), None), ("p", "c2", "m1", D(195), None), ("q", "m2", None, None, D(1))], "p string, id string, up string, d date, due date")
    r = C.parent_child_cohort(e, ["p"], "id", "up", "d", "due")
    assert rows(r.select("episode_id", "child_episode_id", "gestational_days", "gestation_category", "start_date")) == [("m1", "c1", 259, "term", D(0)), ("m1", "c2", 195, "extremely_preterm", D(0))]


def test_insurance_priority_uses_the_full_key(frame, rows):
    chain = frame([("a", 1, None, "UNIFORM"), ("a", 1, "Some MEDICAID plan", "x"), ("a", 2, "Other plan", "x"), ("b", 1, None, "odd")], "p string, inst int, pay string, cls string")
    r = C.payor(chain, ["p", "inst"], "pay", "cls", [(["medicare"], "Medicare"), (["medicaid"], "Medicaid")], "Commercial", {"Medicaid": "M", "Commercial": "C", "Other": "O"}, ["M", "C", "O"], {"UNIFORM": "Other"})
    assert rows(r) == [("a", 1, "M"), ("a", 2, "C")]


def test_notes_yield_the_largest_notation_in_the_window(frame, rows):
    notes = frame([("a", D(5), "seen G2P1011 today"), ("a", D(6), "G1 P0 T0 P2 A1"), ("a", D(99), "G9P9"), ("b", D(5), "nothing")], "p string, t date, txt string")
    people = frame([("a",), ("b",)], "p string")
    r = C.note_history(people, notes, ["p"], "t", "txt", F.lit(D(0)), F.lit(D(10)))
    assert rows(r) == [("a", "G2P1011", 2, 1, 0), ("b", None, 0, 0, 0)]
    codes = frame([("G1 P0 T0 P2 A1",), ("G3P2",), ("G3 P2",)], "c string")
    assert [tuple(r) for r in codes.select(*[v.alias(n) for n, v in C.history_digits(F.col("c")).items()]).collect()] == [("1", "0", "2"), ("3", "2", None), ("3", "2", None)]


def test_a_hot_person_gives_the_same_answer(frame, spark):
    """One person holds most cohort rows and facts; windows still match a direct count."""
    people = spark.range(400).select(F.when(F.col("id") < 300, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id"))).alias("p"), F.col("id").alias("k"), F.date_add(F.lit(D(0)), (F.col("id") * 3).cast("int")).alias("i"))
    facts = spark.range(2000).select(F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") - 1500)).alias("p"), F.date_add(F.lit(D(0)), (F.col("id") * 7 % 1100).cast("int")).alias("t"), (F.col("id") % 40).alias("item"))
    got = T.window_item_counts(people, facts, ["p"], "t", F.date_sub("i", 3), F.date_add("i", 9), "item")
    f = facts.collect()
    for r in got.where("k % 37 = 0").collect():
        assert r.n_items == len({x.item for x in f if x.p == r.p and dt.timedelta(-3) <= x.t - r.i <= dt.timedelta(9)})


def test_staged_applies_steps_in_order(frame, rows):
    df = frame([(1,)], "v int")
    steps = [lambda d: d.withColumn("v", F.col("v") + 1), lambda d: d.withColumn("v", F.col("v") * 10), lambda d: d.withColumn("v", F.col("v") - 1)]
    assert rows(C.staged(df, steps, checkpoint_every=2)) == [(19,)]


def test_stays_near_an_index_are_copied_without_bounds_of_their_own(cohort, frame):
    """What is shuffled of a stay are its own columns and the cell; the widened bounds are not written beside them."""
    stays = frame([("a", D(80), D(105))], "p string, start date, stop date")
    plan = T.overlap_or_near(cohort, stays, ["p"], "i", "start", "stop")._jdf.queryExecution().optimizedPlan().toString()
    assert "__lo" not in plan and "__hi" not in plan and plan.count("Join ") == 1


def test_exposure_profile_joins_the_window_once(cohort, frame, rows):
    from cohortry.plans.exposure import exposure_profile

    facts = frame([("a", D(99), 1, 2.0), ("a", D(99), 1, 3.0), ("a", D(101), 2, 5.0), ("a", D(300), 2, 7.0), ("b", D(130), 3, 1.0)], "p string, t date, item int, v double")
    ids = frame([(1, "x"), (2, "y")], "item int, label string")
    anchors = cohort.where("k in (1, 3, 4)").select("p", "i")
    r = exposure_profile(anchors, facts, ["p"], "i", "t", "item", "v", ids, ["x", "y"], (-14, 60), [0, 14])
    assert rows(r.select("p", "v_sum_0", "v_sum_1", "v_sum_2", "x", "y")) == [("a", 5.0, 5.0, None, 1, 1), ("b", None, None, 1.0, 0, 0), ("c", None, None, None, 0, 0)]
    assert r._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
