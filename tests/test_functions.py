import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortry.functions import clinical as C
from cohortry.functions import probability as Q
from cohortry.functions import scalars as X


def one(frame, value, kind, build):
    return [r[0] for r in frame([(v,) for v in value], f"c {kind}").select(build(F.col("c"))).collect()]


def test_text(frame):
    assert one(frame, [None, " A.(b)  -C: ", "x*y"], "string", X.clean_string) == ["", "ab c", "xy"]
    assert one(frame, ["7", "12345"], "string", lambda c: X.zero_pad_front(c, 3)) == ["007", "345"]
    assert one(frame, ["X12", "12X", "X"], "string", lambda c: X.strip_prefix(c, "X")) == ["12", "12X", ""]
    assert one(frame, ["a|b", "a", None], "string", lambda c: X.split_at(c, "|", 1)) == ["b", None, None]
    assert one(frame, ["G1P1234 G2P1", "G2P1", "no"], "string", lambda c: X.regex_first(c, [r"G\dP\d{4}", r"G\dP\d"])) == ["G1P1234", "G2P1", None]
    assert one(frame, ["Big (i.e. bi-level) MASK", "mask", None], "string", lambda c: X.phrase_tier(c, [(["(i.e. bi-level)"], 5), (["mask"], 4)])) == [5, 4, None]
    assert one(frame, ["06001", "6001"], "string", lambda c: X.derive_key(c, [(F.length(c) == 5, 2, -2)], (0, 2))) == ["600", "60"]


def test_sql_function(spark):
    X.register_sql(spark)
    assert spark.sql("SELECT zero_pad_front('5', 2)").first()[0] == "05"


def test_dates(frame):
    assert one(frame, [dt.date(2024, 8, 31)], "date", lambda c: X.shift(c, months=-6)) == [dt.date(2024, 2, 29)]
    df = frame([(dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 1))], "a timestamp, b timestamp")
    assert tuple(df.select(X.duration_days(F.col("b"), F.col("a")), X.frac_days(F.col("a"), F.col("b"))).first()) == (1.5, 1.5)


def test_arrays(frame):
    assert one(frame, [["a", "a", "b"], ["a"], None], "array<string>", lambda c: X.nth_distinct(c, 2)) == ["b", None, None]
    assert one(frame, [["flush"], ["flush", "x"], [None]], "array<string>", lambda c: X.all_in(c, ["flush"])) == [True, False, False]
    assert one(frame, [["Heparin A"], ["Heparin", "Water"]], "array<string>", lambda c: X.any_without(c, ["heparin"])) == [False, True]
    d = dt.date
    inside = lambda c: X.any_within(c, F.lit("2024-07-01").cast("date"), 6)
    assert one(frame, [[d(2024, 1, 1)], [d(2024, 1, 2)], [d(2024, 7, 1)], [], None], "array<date>", inside) == [False, True, False, False, False]
    assert one(frame, ["a; b", "zz", None], "string", lambda c: X.token_max(c, ";", {"a": 1, "b": 3})) == [3, None, None]


def test_scaling_of_constants_and_nulls(frame, rows):
    df = frame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    assert rows(X.min_max(df, ["a", "b"])) == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    assert rows(X.z_score(df, ["a", "b"])) == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_results_and_stages(frame):
    assert one(frame, [" Not Detected. ", "Detcted", "see  Comment", "?", None], "string", C.result_short) == ["negative", "positive", "see report or comment", "unknown", "unknown"]
    assert one(frame, [["positive", "negative"], ["negative", None], [], None], "array<string>", C.result_category) == [">= 1 positive", ">= 1 negative (no positive)", "inconclusive or unknown", "inconclusive or unknown"]
    assert one(frame, [90, 91, 181, 182, None], "int", C.stage) == ["1st trimester", "2nd trimester", "2nd trimester", "3rd trimester", None]
    assert one(frame, [259, 258, 238, 237, 224, 223, 196, 195, None], "int", C.gestation_category) == ["term", "late_preterm", "late_preterm", "moderate_preterm", "moderate_preterm", "very_preterm", "very_preterm", "extremely_preterm", None]


def test_scores_and_encodings(frame):
    df = frame([(6, 1, "Expired at home"), (6, 1, None), (6, 0, "Home"), (5, 1, "Home"), (None, None, None)], "n int, s int, d string")
    assert [r[0] for r in df.select(C.adjusted_score(F.col("n"), [F.col("s") > 0], F.col("d"))).collect()] == [8, 7, 6, 5, None]
    cons = lambda c: C.consolidate(c, {"White": "White or Caucasian"}, ["Unknown", "Declined"])
    assert one(frame, [["White", "White or Caucasian"], ["Other", "Asian"], ["Other"], ["Asian", "White"], ["Unknown"], [], None], "array<string>", cons) == ["White or Caucasian", "Asian", "Other", "Multiracial", "Unknown", "Unknown", "Unknown"]
    assert one(frame, [14.9, 18.5, 40.0, None, float("nan")], "double", lambda c: C.bin_code(c, [18.5, 25, 40], [0, 1, 2, -1], -9)) == [0, 1, -1, -9, -9]
    eras = [("one", "2020-03-05", "2021-04-24"), ("two", "2021-04-24", "2022-01-01")]
    assert one(frame, [dt.date(2020, 3, 4), dt.date(2020, 3, 5), dt.date(2021, 4, 24), dt.date(2022, 1, 1)], "date", lambda c: C.period(c, eras)) == [None, "one", "two", None]
    assert one(frame, [None, 0, 1, 2], "int", lambda c: C.preterm_history(c, F.lit(258))) == [0, 0, 0, 1]
    assert one(frame, [1], "int", lambda c: C.preterm_history(c, F.lit(259))) == [1]
    with pytest.raises(ValueError):
        C.bin_code(F.lit(1), [1], [0])


def test_probability_expressions(frame):
    xs = [0.0, 0.3, 1.0, 1.99, 2.0, 4.0, 9.0]
    for x, got in zip(xs, one(frame, xs, "double", Q.erfc)):
        assert got == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-300)
    ns = [0, 1, 5, 170, 10**6, 10**9]
    for n, got in zip(ns, one(frame, ns, "long", Q.ln_factorial)):
        assert got == pytest.approx(math.lgamma(n + 1.0), rel=1e-11, abs=1e-10)
    zs = [0.5, 1.96, 5.0, 40.0]
    logs = one(frame, zs, "double", Q.log10_normal_two_sided)
    for z, got in zip(zs[:3], logs):
        assert got == pytest.approx(math.log10(math.erfc(z / 2**0.5)), rel=1e-9)
    assert logs[3] == pytest.approx(-349.136, abs=1e-2)
    # known upper tails: chi²(3.841458820694124, 1) = 0.05, (5.991464547107979, 2), (7.814727903251179, 3), (18.307038053275146, 10)
    table = [(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (18.307038053275146, 10)]
    got = [r[0] for r in frame(table, "x double, k int").select(Q.chi_square_sf(F.col("x"), F.col("k"))).collect()]
    assert got == pytest.approx([0.05] * 4, rel=1e-9)
