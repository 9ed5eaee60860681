"""Stored steps of a plan: joined as they lie, and cleared."""

from pyspark.sql import functions as F

from cohortry.sources import io


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_steps_are_joined_without_an_exchange(spark, rows, tmp_path):
    base = spark.range(500).select((F.col("id") % 97).alias("p"), "id")
    steps = [io.stage(base.groupBy("p").agg(f("id").alias(n)), ["p"], 4, path=str(tmp_path / n)) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    merged = [s.hint("merge") for s in steps]
    both = merged[0].join(merged[1], "p").join(merged[2], "p").groupBy("p").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    assert "Exchange" not in plan(both) and plan(both).count("SortMergeJoin") == 2
    want = base.groupBy("p").agg(F.count("id"), F.max("id"), F.min("id"))
    assert rows(both) == rows(want)
    other = io.stage(base.groupBy("p").agg(F.avg("id").alias("mean")), ["p"], 3, path=str(tmp_path / "mean"))
    assert "Exchange" in plan(merged[0].join(other.hint("merge"), "p"))  # other buckets need one


def test_null_keys_and_no_rows(frame, rows, tmp_path):
    df = frame([(None, 1), ("a", 2), (None, 3)], "p string, v int")
    assert rows(io.stage(df, ["p"], 2, path=str(tmp_path / "a"))) == rows(df)
    assert rows(io.stage(df.limit(0), ["p"], 2, path=str(tmp_path / "b"))) == []


def test_stages_are_cache_tables(spark, frame, tmp_path):
    io.stage(frame([("a", 2)], "p string, v int"), ["p"], 2, path=str(tmp_path / "c"))
    listed = [n for n in io.list_tables(spark, include_cache=True) if n.startswith(io.CACHE_PREFIX)]
    assert listed and not set(listed) & set(io.list_tables(spark))
