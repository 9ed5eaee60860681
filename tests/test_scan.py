"""Running aggregates, ranks and quantiles against plain Python, with ties, nulls and one hot group."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortry.operators import aggregate as A
from cohortry.operators import scan as S
from cohortry.operators.quantiles import exact_quantiles


def hot(n=3000, seed=5):
    """A third of all rows in one group, plus many small ones."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(50)}", rng.randrange(200), i) for i in range(n)]


@pytest.fixture(scope="module")
def data(frame):
    return frame(hot(), "k string, v int, id int")


@pytest.mark.parametrize("cells", [1, 3, 17])
@pytest.mark.parametrize("descending", [False, True])
def test_prefix_scan_matches_running_totals(data, cells, descending):
    counts = data.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = S.prefix_scan(counts, ["k"], "v", {"s": ("sum", "n"), "hi": ("max", "m"), "lo": ("min", "m")}, descending, cells)
    want = {}
    groups = {}
    for k, v, n, m in (tuple(r) for r in counts.collect()):
        groups.setdefault(k, []).append((v, n, m))
    for k, items in groups.items():
        s, ms = 0, []
        for v, n, m in sorted(items, reverse=descending):
            s += n
            ms.append(m)
            want[k, v] = (s, max(ms), min(ms))
    assert {(r.k, r.v): (r.s, r.hi, r.lo) for r in got.collect()} == want


def test_prefix_scan_rejects_unknown_function(data):
    with pytest.raises(ValueError):
        S.prefix_scan(data, [], "v", {"x": ("avg", "id")})


def test_null_keys_and_null_order_are_kept(frame, rows):
    df = frame([(None, None, 1), (None, 2, 1), ("a", 1, 5)], "k string, v int, n int")
    assert rows(S.prefix_scan(df, ["k"], "v", {"s": ("sum", "n")}, cells=4)) == rows(frame([(None, None, 1, 1), (None, 2, 1, 2), ("a", 1, 5, 5)], "k string, v int, n int, s int"))


def test_quantiles(data):
    got = {r.k: (r.q1, r.q2) for r in exact_quantiles(data, ["k"], ["v"], {"q1": 0.5, "q2": 0.9}).collect()}
    groups = {}
    for k, v, _ in hot():
        groups.setdefault(k, []).append(v)
    for k, vs in groups.items():
        vs.sort()
        pos = 0.9 * (len(vs) - 1)
        high = vs[int(pos)] + (vs[min(int(pos) + 1, len(vs) - 1)] - vs[int(pos)]) * (pos - int(pos))
        assert got[k][0] == statistics.median(vs)
        assert got[k][1] == pytest.approx(high)


def test_global_quantile_ignores_nulls(frame):
    df = frame([(1.0,), (None,), (4.0,), (2.0,)], "v double")
    assert exact_quantiles(df, [], ["v"], {"m": 0.5}).collect()[0].m == 2.0


def test_rank_rows_equals_row_number(data):
    uniq = data.select("k", "v").distinct()
    got = {(r.k, r.v): r.rn for r in S.rank_rows(uniq, [], ["v", "k"], "rn").collect()}
    assert got == {kv: i for i, kv in enumerate(sorted({(k, v) for k, v, _ in hot()}, key=lambda x: (x[1], x[0])), 1)}


def test_ordered_list_chunks_join_to_the_whole_list(data):
    chunks = A.ordered_list(data, ["k"], "v", "id", chunk=70).collect()
    assert max(len(c["values"]) for c in chunks) == 70
    for key in ("hot", "k7"):
        parts = sorted((c.chunk_no, c["values"]) for c in chunks if c.k == key)
        assert [v for _, p in parts for v in p] == [v for k, v, _ in sorted(hot(), key=lambda r: r[2]) if k == key]


def test_ordered_list_splits_runs_of_equal_rows(frame):
    df = frame([("a", 1, "x")] * 7 + [("a", 2, "y")], "k string, o int, v string")
    got = {r.chunk_no: r["values"] for r in A.ordered_list(df, ["k"], "v", "o", chunk=3).collect()}
    assert got == {0: ["x"] * 3, 1: ["x"] * 3, 2: ["x", "y"]}


def test_result_does_not_depend_on_partitioning(data, rows):
    a = exact_quantiles(data.repartition(1), ["k"], ["v"], {"m": 0.3})
    b = exact_quantiles(data.repartition(7, "v"), ["k"], ["v"], {"m": 0.3})
    assert rows(a) == rows(b)


def test_scan_spreads_the_rest_beside_a_heavy_value_and_keeps_nothing_on_the_driver(spark):
    df = spark.range(200_000, numPartitions=200).select(F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(-1).alias("v"))
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = S.prefix_scan(counts, [], "v", {"upto": ("sum", "n")}, cells=16)
    assert got.agg(F.max("upto")).first()[0] == 200_000
    ranged = counts.repartitionByRange(16, "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) >= 12 and max(r["count"] for r in ranged) <= 40


def test_near_linear_matching(spark):
    """Comparisons per row hardly grow with the rows."""
    from cohortry.operators import matching as M

    for n, cols in ((400, ["a"]), (400, ["a", "b", "c"])):
        df = spark.range(n).select("id", *[F.rand(i + 1).alias(c) for i, c in enumerate(cols)], (F.col("id") % 2).alias("t"))
        rows = {r["id"]: r for r in df.collect()}
        pairs = M.match_nearest(df.where("t = 1"), df.where("t = 0"), "id", cols, scale=False, pairs_per_row=4).collect()
        for p in pairs:
            dist = lambda x, y: sum((rows[x][c] - rows[y][c]) ** 2 for c in cols) ** 0.5
            best = min((dist(p["treated"], i), i) for i in rows if rows[i]["t"] == 0)
            assert p["control"] == best[1] and abs(p["distance"] - best[0]) < 1e-9
        assert len(pairs) == n // 2
