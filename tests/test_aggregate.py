import datetime as dt

import pytest

from cohortry.operators import aggregate as A
from cohortry.operators import timewin as W


@pytest.fixture(scope="module")
def facts(frame):
    return frame(
        [("a", 3, 1, True), ("a", 1, None, False), ("a", 2, 5, None), (None, 1, 2, True), ("b", 1, None, None)],
        "k string, o int, v int, flag boolean",
    )


def test_all_functions(facts):
    r = {x.k: x for x in A.aggregate(facts, ["k"], {"v": ["sum", "count", "median", "first", "last", "collect_list", "collect_set", "concat_ws", "stddev"], "flag": ["mean", "sum", "max"]}, "o").collect()}
    assert (r["a"].v_sum, r["a"].v_count, r["a"].v_median, r["a"].v_first, r["a"].v_last) == (6, 2, 3.0, None, 1)
    assert (r["a"].v_collect_list, r["a"].v_collect_set, r["a"].v_concat_ws) == ([5, 1], [1, 5], "5;1")
    assert (r["a"].flag_mean, r["a"].flag_sum, r["a"].flag_max) == (0.5, 1, True)
    assert r[None].v_sum == 2 and r[None].v_stddev is None
    assert (r["b"].v_sum, r["b"].v_median, r["b"].v_collect_list, r["b"].v_concat_ws) == (None, None, [], "")


def test_arguments_are_checked_and_left_alone(facts):
    aggs = {"v": "sum"}
    A.aggregate(facts, ["k"], aggs)
    assert aggs == {"v": "sum"}
    with pytest.raises(ValueError):
        A.aggregate(facts, ["k"], {"v": "mode"})
    with pytest.raises(ValueError):
        A.aggregate(facts, ["nope"], {"v": "sum"})


def test_dedupe_is_deterministic(frame, rows):
    df = frame([("a", 2, "y"), ("a", 1, "z"), ("a", 1, "x")], "k string, o int, v string")
    assert rows(A.dedupe(df, ["k"], "o")) == rows(A.dedupe(df.repartition(3), ["k"], "o")) == [("a", 1, "x")]


def test_window_buckets(frame):
    t = dt.datetime(2024, 2, 29, 13, 5)
    df = frame([(t,), (None,)], "ts timestamp")
    got = {u: [r.w for r in W.add_window(df, "ts", "w", u).collect()] for u in W.UNITS}
    assert got["year"] == [2024, None] and got["month"] == ["2024-02", None] and got["day"] == ["2024-02-29", None]
    assert got["12hour"] == ["2024-02-29-01", None] and got["6hour"] == ["2024-02-29-02", None] and got["hour"] == ["2024-02-29-13", None]
    with pytest.raises(ValueError):
        W.add_window(df, "ts", "w", "week")


def test_relative_bucket_boundaries(frame):
    day = dt.date(2024, 1, 10)
    df = frame([(day + dt.timedelta(d), day) for d in (-1, 0, 13, 14)] + [(None, day)], "t date, ref date")
    bounds = [14, 0]
    got = [r.w for r in W.add_relative_window(df, "t", "ref", bounds, "w").collect()]
    assert got == [0, 1, 1, 2, None] and bounds == [14, 0]


def test_wide_layout_is_the_pivot_of_the_long_one(frame):
    day = dt.date(2024, 1, 10)
    df = frame([(k, day + dt.timedelta(d), day, v) for k, d, v in (("a", -3, 1), ("a", 0, 2), ("a", 20, 3), (None, 5, 4), ("b", 1, 5))], "k string, t date, ref date, v int")
    args = (df, ["k"], {"v": ["sum", "max"]}, "t", "ref", [0, 14])
    long = {(r.k, r.time_index): (r.time_index_label, r.v_sum, r.v_max) for r in W.aggregate_custom(*args, labels=["pre", "early"], layout="long").collect()}
    wide = {r.k: r for r in W.aggregate_custom(*args, labels=["pre", "early"]).collect()}
    assert long["a", 2][0] == "2" and long["a", 0][0] == "pre"
    for (k, i), (label, s, m) in long.items():
        assert wide[k][f"v_sum_{label}"] == s and wide[k][f"v_max_{label}"] == m
    assert wide["b"]["v_sum_pre"] is None and wide[None]["v_sum_early"] == 4


def test_labels_need_integer_windows(frame):
    df = frame([("a", "2024-01", 1)], "k string, w string, v int")
    with pytest.raises(ValueError):
        W.aggregate_by_window(df, ["k"], "w", {"v": "sum"}, labels=["x"])


def test_ledger_keeps_distinct_days(frame):
    d = dt.date(2024, 1, 1)
    df = frame([("a", d, "z"), ("a", d, "p"), ("a", dt.date(2024, 3, 1), "m"), ("a", None, "q")], "k string, d date, v string")
    r = W.ledger(df, ["k"], "d", "v").collect()[0]
    assert (r.first_label, r.last_label, len(r.entries)) == ("p", "m", 2)


def test_distinct_ids_by_bitmaps(spark, rows):
    """Negative, zero, large, repeated and null values, a null key, a group without values and one hot group."""
    import random

    rng = random.Random(9)
    made = [(rng.choice(["hot"] * 5 + ["a", None]), rng.choice([None, 0, 1, -1, 32768, 32769, -32768, -32769, 2**62, -(2**62), rng.randrange(-70_000, 70_000)]), rng.randrange(40)) for _ in range(5000)]
    made += [("empty", None, None)]
    want = {}
    for k, v, w in made:
        one = want.setdefault(k, (set(), set()))
        one[0].add(v)
        one[1].add(w)
    got = A.count_distinct_ids(spark.createDataFrame(made, "k string, v long, w int").repartition(5), ["k"], ["v", "w"])
    assert rows(got) == sorted(((k, len(v - {None}), len(w - {None})) for k, (v, w) in want.items()), key=repr)
    assert rows(A.count_distinct_ids(spark.createDataFrame(made, "k string, v long, w int"), [], ["v"])) == [(len({v for _, v, _ in made} - {None}),)]
