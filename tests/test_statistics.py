import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from cohortry.operators import features as E
from cohortry.operators import matching as M
from cohortry.operators import models as L
from cohortry.operators import profile as P
from cohortry.operators import state as S
from cohortry.operators import stats as T


def test_caliper_match_equals_brute_force(frame, rows):
    rng = random.Random(1)
    units = [(i, int(rng.random() < 0.3), round(rng.choice([0.5, rng.random() * 4]), 2)) for i in range(240)] + [(900, 1, 99.0), (901, 1, None)]
    got = M.match_caliper(frame(units, "id int, t int, s double"), "id", "t", "s", 0.2)
    want = []
    for i, t, s in units:
        if t == 1 and s is not None:
            near = sorted((abs(s - s2), j) for j, t2, s2 in units if t2 == 0 and abs(s - s2) <= 0.2)
            if near:
                want.append((i, near[0][1], near[0][0]))
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("pairs_per_row", [1, 50])
def test_nearest_match_equals_brute_force(frame, pairs_per_row):
    rng = random.Random(2)
    point = lambda: tuple(round(rng.gauss(0, 1) if rng.random() < 0.7 else rng.random() * 0.01, 3) for _ in range(4))
    t, c = [(i, *point()) for i in range(40)] + [(99, 30.0, 30.0, 0.0, 0.0)], [(1000 + i, *point()) for i in range(150)]
    c.append((2000, *c[0][1:]))
    schema, cols = "id int, a double, b double, c double, d double", ["a", "b", "c", "d"]
    got = {r.treated: (r.control, r.distance) for r in M.match_nearest(frame(t, schema), frame(c, schema), "id", cols, scale=False, pairs_per_row=pairs_per_row).collect()}
    assert len(got) == len(t)
    for i, *x in t:
        d, j = min((math.dist(x, y), k) for k, *y in c)
        assert got[i][1] == pytest.approx(d) and got[i][0] == j


def test_nearest_match_of_far_apart_clusters_stays_small(frame):
    """Two dense clusters with no common region: box pruning must still find exact neighbours."""
    rng = random.Random(6)
    near = lambda at: (at + rng.random(), rng.random(), float(rng.random() < 0.5))
    t, c = [(i, *near(0)) for i in range(120)], [(500 + i, *near(50)) for i in range(300)]
    schema = "id int, a double, b double, c double"
    got = {r.treated: r.control for r in M.match_nearest(frame(t, schema), frame(c, schema), "id", ["a", "b", "c"], scale=False, pairs_per_row=5).collect()}
    assert got == {i: min((math.dist(x, y), k) for k, *y in c)[1] for i, *x in t}


def test_balance_counts_reused_controls(frame):
    df = frame([(1, 1, 1.0), (2, 1, 3.0), (3, 0, 1.0), (4, 0, 9.0)], "id int, t int, x double")
    pairs = frame([(1, 3, 0.0), (2, 3, 0.0)], "treated int, control int, d double")
    r = M.balance(df, pairs, "id", "t", ["x"]).first()
    sd = math.sqrt((2.0 + 32.0) / 2)
    assert r.smd_before == pytest.approx((2 - 5) / sd) and r.smd_after == pytest.approx((2 - 1) / sd)


def test_propensity_needs_both_arms(frame):
    with pytest.raises(ValueError):
        M.propensity(frame([(1, 1.0)], "t int, x double"), "t", ["x"])


def fisher(a, b, c, d):
    r1, r2, c1 = a + b, c + d, a + c
    p = lambda k: math.comb(r1, k) * math.comb(r2, c1 - k) / math.comb(r1 + r2, c1)
    return min(1.0, sum(p(k) for k in range(max(0, c1 - r2), min(r1, c1) + 1) if p(k) <= p(a) * (1 + 1e-7)))


def test_fisher_2x2(frame):
    cells = [(3, 1, 1, 3), (0, 10, 12, 2), (8, 2, 1, 5), (0, 0, 3, 4), (5, 0, 7, 0), (3, 1, 1, 3), (40, 60, 55, 45), (2000, 1000, 1500, 1600)]
    table = frame([(i, *x) for i, x in enumerate(cells)], "i int, a int, b int, c int, d int")
    got = {r.i: r for r in T.fisher_2x2(table).collect()}
    assert len(got) == len(cells)
    for i, x in enumerate(cells):
        exact = fisher(*x) if sum(x) < 1000 else 0.0
        assert got[i].p_value == pytest.approx(exact, rel=1e-7, abs=1e-12) and 0 <= got[i].p_value <= 1
    swapped = {r.i: r.p_value for r in T.fisher_2x2(table, "c", "d", "a", "b").collect()}
    assert all(swapped[i] == pytest.approx(got[i].p_value, rel=1e-9, abs=1e-12) for i in got)


def test_monte_carlo_fisher_is_near_the_exact_value(frame):
    rows = [("u", "x")] * 8 + [("u", "y")] * 2 + [("v", "x")] + [("v", "y")] * 5
    r = T.fisher_mc(frame(rows, "r string, c string"), "r", "c", 4000, 3).first()
    assert abs(r.p_value - fisher(8, 2, 1, 5)) < 5 * r.std_error + 1e-3


def test_mann_whitney_with_ties_and_nulls(frame):
    a, b = [1, 2, 2, 5, None], [2, 3, 3, 7]
    df = frame([("a", x) for x in a] + [("b", x) for x in b], "g string, v int")
    r = T.mann_whitney(df, "g", "v", "a", "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x, y in product([x for x in a if x is not None], b))
    assert r.u == u and (r.n1, r.n2) == (4, 4)
    assert T.mann_whitney(df, "g", "v", "b", "a").first().p_value == pytest.approx(r.p_value)
    same = frame([("a", 1), ("b", 1)], "g string, v int")
    assert T.mann_whitney(same, "g", "v", "a", "b").first().p_value == 1.0


def test_prevalence_at_the_ends(frame):
    df = frame([("n", 0)] * 10 + [("y", 1)] * 10, "g string, f int")
    r = {x.g: x for x in T.prevalence(df, ["g"], "f").collect()}
    assert r["n"].ci_low == pytest.approx(0, abs=1e-12) and r["y"].ci_high == pytest.approx(1) and r["n"].ci_high == pytest.approx(0.2775, abs=1e-3)


def scored(n=120, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        out.append((i, y, round(rng.gauss(y, 1.2), 1), round(rng.gauss(0.5 * y, 1), 1), rng.choice([1.0, 2.0, 5.0])))
    return out


def test_auc_properties(frame):
    data = scored()
    df = frame(data, "id int, y int, a double, b double, w double")
    auc = L.auc_delong(df, "y", "a").first()
    pos, neg = [r[2] for r in data if r[1]], [r[2] for r in data if not r[1]]
    assert auc.auc == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
    flipped = L.auc_delong(df.withColumn("a", -F.col("a")), "y", "a").first()
    assert flipped.auc == pytest.approx(1 - auc.auc) and flipped.variance == pytest.approx(auc.variance)
    unit = L.auc_delong(df.withColumn("w", F.lit(3.0)), "y", "a", "w").first()
    assert (unit.auc, unit.variance) == pytest.approx((auc.auc, auc.variance))
    same = L.auc_compare(df.withColumn("c", F.col("a") * 2), "y", "a", "c").first()
    assert same.z is None or abs(same.z) < 1e-6
    perfect = L.auc_delong(df.withColumn("a", F.col("y").cast("double")), "y", "a").first()
    assert perfect.auc == 1.0 and perfect.ci_high == 1.0
    with pytest.raises(Exception, match="both classes"):
        L.auc_delong(df.where("y = 1"), "y", "a").collect()


def test_curves_end_at_full_recall(frame):
    df = frame(scored(), "id int, y int, a double, b double, w double")
    last = L.roc(df, "y", "a").orderBy("threshold").first()
    assert (last.tpr, last.fpr) == (1.0, 1.0)
    assert 0 < L.pr_auc(df, "y", "a").first().pr_auc < 1


def test_undersample_and_folds(frame):
    df = frame([(i, int(i % 10 == 0)) for i in range(200)], "id int, y int")
    for replacement in (False, True):
        got = L.undersample(df, "y", "id", 3, replacement)
        assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == {0: 20, 1: 20}
    a = {r.id for r in L.undersample(df, "y", "id", 3).collect()}
    assert a == {r.id for r in L.undersample(df.repartition(5), "y", "id", 3).collect()}
    folds = df.select(L.fold(F.col("id"), 4, 1).alias("f")).distinct().collect()
    assert {r.f for r in folds} == {0, 1, 2, 3}


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosting"])
def test_out_of_fold_scores_cover_every_row_once(frame, kind):
    df = frame(scored(90), "id int, y int, a double, b double, w double")
    small = {"forest": {"numTrees": 3, "maxDepth": 2}, "boosting": {"maxIter": 2, "maxDepth": 2}}.get(kind, {})
    r = L.oof_predict(df, "id", "y", ["a", "b"], kind, k=2, **small)
    assert r.count() == 90 and r.select("id").distinct().count() == 90


def test_model_round_trip(frame, tmp_path):
    rng = random.Random(8)
    rows = [(p, t, rng.gauss(p % 2, 1.0), int(p % 2 and t == 2)) for p in range(60) for t in (1, 2)]
    model, info = L.cohort_logit(frame(rows, "p int, t int, x double, y int"), ["p"], "t", ["x"], "y")
    assert info["positive_patient_count"] == 30 and info["negative_patient_count"] == 30 and 0.5 < info["auc_roc"] <= 1
    L.save_model(model, info, str(tmp_path / "m"))
    again, stored, table = L.load_model(str(tmp_path / "m"))
    assert stored == info and table.first().coefficient == pytest.approx(model.coefficients[0]) == again.coefficients[0]


def test_chart_percentile_bands_and_clamps(frame, rows):
    chart = frame([("f", x, p, 100.0 * x + p) for x in (10, 11) for p in (5.0, 50.0, 95.0)], "g string, x int, percentile double, value double")
    df = frame([(1, "f", 10.0, 1000.0), (2, "f", 10.0, 1050.0), (3, "f", 10.5, 1100.0), (4, "f", 10.0, 1027.5), (5, "f", 99.0, 2000.0), (6, "f", 1.0, 1050.0), (7, "f", None, 1.0), (8, "m", 10.0, 1.0), (9, "f", 10.0, None)], "id int, g string, x double, y double")
    got = {r.id: r.percentile for r in S.chart_percentile(df, "g", "x", "y", chart).collect()}
    assert got == {1: 5.0, 2: 50.0, 3: 50.0, 4: 27.5, 5: 95.0, 6: 50.0, 7: None, 8: None, 9: None}


def test_rules_levels_and_worst_records(frame, rows):
    df = frame([("a", "q"), ("a", None), ("z", "q")], "i string, f string")
    rules = frame([("a", "q", 1, 2), ("a", None, 5, 1)], "item string, detail string, priority int, class int")
    assert rows(S.rule_class(df, rules, "i", "f")) == [("a", "q", 2), ("a", None, 1), ("z", "q", 0)]
    dev = frame([("p", "mask; cannula", False), ("p", "room air", True), ("q", "odd", None)], "k string, d string, v boolean")
    assert rows(S.level_max(dev, ["k"], "d", {"cannula": 1, "mask": 2}, ";", (F.col("v"), 2, 3))) == [("p", 3), ("q", 0)]
    low = frame([("p", "cannula", True), ("q", "mask", False), ("q", None, True), ("r", "none", True)], "k string, d string, v boolean")
    assert rows(S.level_max(low, ["k"], "d", {"cannula": 1, "mask": 2}, ";", (F.col("v"), 2, 3))) == [("p", 1), ("q", 2), ("r", 0)]
    assert [r[0] for r in frame([("Ventilator",), ("Bubble CPAP",), ("NC",), ("Room Air",), ("?",), (None,)], "c string").select(S.device_score(F.col("c"))).collect()] == [6, 5, 4, 3, None, None]


def test_matrix_and_imputation(frame, rows):
    df = frame([(1, "x", 2.0), (2, "y", None), (3, None, 4.0)], "id int, c string, v double")
    assert rows(E.one_hot(df, "c", ["x", "y"]).select("id", "c_x", "c_y")) == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    assert rows(E.impute_median(df, ["v"]).select("id", "v")) == [(1, 2.0), (2, 3.0), (3, 4.0)]
    with pytest.raises(ValueError):
        E.design_matrix(df, E.MatrixSpec(["id"], ["nope"]))
    assert rows(E.numeric_complete(frame([("a", "b", "1.5"), ("ab", "", "x")], "i string, j string, v string"), ["v"], ["i", "j"])) == [("a|b", 1.5)]


def test_profile_counts(frame):
    df = frame([("a", 1, ["x"]), ("a", 2, None), (None, 1, ["x"]), ("b" * 80, 1, [])], "s string, instance int, l array<string>")
    r = {x.field_name: x for x in P.table_profile(df, "t", "instance").collect()}
    assert (r["s"].records_cnt, r["s"].unique_cnt, r["s"].instance_unique_cnt, r["s"].null_cnt) == (4, 2, 3, 1)
    assert (r["l"].unique_cnt, r["l"].null_cnt, r["l"].instance_unique_cnt) == (2, 1, 2)
    assert P.table_profile(df, "t").where("field_name = 's'").first().instance_unique_cnt is None
    sketch = {x.field_name: x.unique_cnt for x in P.table_profile(df, "t", "instance", approx=True).collect()}
    assert sketch["s"] == 2
    v = P.field_values({"t": (df, ["s", ("s", "instance")])}, "instance")
    assert v.count() == 4 + 4 and v.where("row_id = 1 AND secondary_field_name = ''").first().field_value is None
