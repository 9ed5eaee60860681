import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import filters as P
from cohortry.operators import joins as J
from cohortry.operators import ordering as O
from cohortry.operators import temporal as T


def pairs(n, seed):
    rng = random.Random(seed)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(700))
    points = [("hot" if i % 3 else f"k{rng.randrange(9)}", i, day()) for i in range(n)] + [(None, -1, day()), ("hot", -2, None)]
    spans = []
    for i in range(n // 2):
        a = day()
        spans.append(("hot" if i % 3 == 0 else f"k{rng.randrange(9)}", i, a, a + dt.timedelta(rng.randrange(-5, 200))))
    return points, spans + [("hot", -9, None, day()), (None, -8, day(), day())]


@pytest.mark.parametrize("bucket", [1, 7, 50, 1000])
def test_range_join_equals_band_join(frame, rows, bucket):
    points, spans = pairs(150, 3)
    p, s = frame(points, "k string, pid int, t date"), frame(spans, "k string, sid int, lo date, hi date")
    got = J.range_join(p, s, ["k"], "t", "lo", "hi", bucket).select("k", "pid", "sid")
    want = J.join(p, s, ["k"], "inner", "a.t BETWEEN b.lo AND b.hi").select("k", "pid", "sid")
    assert rows(got) == rows(want)
    for how in ("left_semi", "left_anti"):
        got = J.range_join(p, s, ["k"], "t", "lo", "hi", bucket, how)
        assert rows(got) == rows(J.join(p, s, ["k"], how, "a.t BETWEEN b.lo AND b.hi"))


@pytest.mark.parametrize("bucket", [1, 30, 400])
def test_range_join_with_open_ended_intervals(frame, rows, bucket):
    points, spans = pairs(120, 9)
    spans += [("hot", 7000, dt.date(1900, 1, 1), dt.date(9999, 12, 31)), ("k1", 7001, dt.date(2020, 5, 1), dt.date(9999, 12, 31))]
    p, s = frame(points, "k string, pid int, t date"), frame(spans, "k string, sid int, lo date, hi date")
    got = J.range_join(p, s, ["k"], "t", "lo", "hi", bucket, long_spans=True).select("k", "pid", "sid")
    assert rows(got) == rows(J.join(p, s, ["k"], "inner", "a.t BETWEEN b.lo AND b.hi").select("k", "pid", "sid"))
    for how in ("left_semi", "left_anti"):
        assert rows(J.range_join(p, s, ["k"], "t", "lo", "hi", bucket, how, True)) == rows(J.join(p, s, ["k"], how, "a.t BETWEEN b.lo AND b.hi"))


@pytest.mark.parametrize("bucket", [1, 30, 400])
def test_overlap_join_meets_each_pair_once(frame, rows, bucket):
    _, a = pairs(80, 4)
    _, b = pairs(60, 5)
    left, right = frame(a, "k string, i int, x date, y date"), frame(b, "k string, j int, u date, v date")
    got = T.overlap_join(left, right, ["k"], ("x", "y"), ("u", "v"), bucket).select("k", "i", "j")
    want = [(ka, i, j) for ka, i, x, y in a for kb, j, u, v in b if ka and ka == kb and None not in (x, y, u, v) and x <= y and u <= v and x <= v and u <= y]
    assert rows(got) == sorted(want, key=repr)


def test_range_join_rejects_shared_columns(frame):
    df = frame([("a", 1, 1, 2)], "k string, t int, lo int, hi int")
    with pytest.raises(ValueError):
        J.range_join(df, df, ["k"], "t", "lo", "hi")


def test_null_keys_survive_only_left_and_anti(frame, rows):
    a, b = frame([(None, 1), ("x", 2)], "k string, v int"), frame([(None, 9), ("x", 8)], "k string, w int")
    assert rows(J.join(a, b, ["k"])) == [("x", 2, 8)]
    assert rows(J.join(a, b, ["k"], "left")) == [("x", 2, 8), (None, 1, None)]
    assert rows(J.join(a, b, ["k"], "left_anti")) == [(None, 1)]
    assert rows(J.status_flag(a, b, ["k"], "s")) == [("x", 2, 1), (None, 1, 0)]


def test_spine_keeps_keys_of_one_table_only(frame, rows):
    a, b = frame([("x", 1), (None, 2)], "k string, a int"), frame([("y", 3)], "k string, b int")
    assert rows(J.spine_join([a, b], ["k"])) == [("x", 1, None), ("y", None, 3), (None, 2, None)]


def test_attrition_counts_prefixes(frame, rows):
    df = frame([(1, "a"), (2, None), (3, "b")], "v int, s string")
    assert rows(P.attrition(df, [("has s", "s IS NOT NULL"), ("big", F.col("v") > 1)])) == [(0, "all", 3), (1, "has s", 2), (2, "big", 1)]


def test_active_at_boundaries(frame):
    d = dt.date
    df = frame([(d(2024, 1, 1), None, "Active"), (d(2024, 1, 11), None, None), (d(2024, 1, 1), d(2024, 1, 10), None), (d(2024, 1, 1), d(2024, 1, 9), None), (d(2024, 1, 1), None, "Deleted")], "n date, r date, s string")
    at = F.lit("2024-01-10").cast("date")
    assert [x.a for x in df.select(P.active_at(F.col("n"), F.col("r"), F.col("s"), at).alias("a")).collect()] == [True, False, True, False, False]


def test_sentinel_spares_other_types(frame, rows):
    df = frame([(-999.0, "x"), (1.0, "-999.0")], "a double, b string")
    assert rows(P.null_if(df, ["a", "b"], -999.0)) == [(1.0, None), (None, "x")]


def test_set_operations_and_order(frame, rows):
    a, b = frame([(1, "p"), (2, "q")], "k int, v string"), frame([(2, "r"), (3, "s")], "k int, v string")
    assert rows(O.difference(a, b, ["k"])) == [(1, "p")] and rows(O.intersect(a, b, ["k"])) == [(2, "q")]
    assert rows(O.union_distinct(a, b, keys=["k"])) == [(1, "p"), (2, "q"), (3, "s")]
    ids = frame([(i,) for i in range(50)], "k int")
    assert [r.k for r in O.shuffle(ids, "k", 7).collect()] == [r.k for r in O.shuffle(ids.repartition(5), "k", 7).collect()] != list(range(50))


@pytest.mark.parametrize("bucket", [1, 7])
@pytest.mark.parametrize("lengths", [(0, 5), (900, 2_000_000), (3, 900)])
def test_range_join_asks_for_the_grids_in_use(frame, rows, bucket, lengths):
    p = frame([("a", i, i * 31) for i in range(60)], "k string, pid int, t int")
    s = frame([("a", i, i * 67, i * 67 + lengths[i % 2]) for i in range(20)], "k string, sid int, lo int, hi int")
    got = J.range_join(p, s, ["k"], "t", "lo", "hi", bucket, long_spans=True, ask=True).select("k", "pid", "sid")
    assert rows(got) == rows(J.join(p, s, ["k"], "inner", "a.t BETWEEN b.lo AND b.hi").select("k", "pid", "sid"))
    none = J.range_join(p, s.limit(0), ["k"], "t", "lo", "hi", bucket, long_spans=True, ask=True)
    assert none.count() == 0


def test_points_are_offered_once_where_no_interval_is_wide(frame):
    p, s = frame([("a", 3)], "k string, t int"), frame([("a", 0, 9)], "k string, lo int, hi int")
    plan = J.range_join(p, s, ["k"], "t", "lo", "hi", 5, long_spans=True, ask=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and "[5,320]" in plan


def test_overlap_join_is_one_join_for_short_and_long_spans(frame, rows):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    spans = lambda step, lengths: [("a", i, day(i * step), day(i * step + lengths[i % len(lengths)])) for i in range(24)] + [("a", 99, day(9), day(3)), (None, 98, day(0), day(9)), ("a", 97, day(1), None)]
    for one, other in (((0, 9), (0, 30)), ((4, 900), (1, 8)), ((2, 8), (3, 2_000_000)), ((700_000, 5), (900, 12))):
        left, right = frame(spans(11, one), "k string, i int, x date, y date"), frame(spans(17, other), "k string, j int, u date, v date")
        got = T.overlap_join(left, right, ["k"], ("x", "y"), ("u", "v"), 5)
        want = J.join(left, right, ["k"], "inner", "a.x <= b.v AND b.u <= a.y AND a.x <= a.y AND b.u <= b.v")
        assert rows(got.select("k", "i", "j")) == rows(want.select("k", "i", "j"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
