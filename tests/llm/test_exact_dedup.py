"""Exact duplicates against brute force, and the parts of the exchange."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.llm import exact_dedup
from cohortry.llm.store import importable

#: Columns that the operator uses inside.
CLASHING = "num long, body string, id string, text string, row string, sender string, r string, h string, digest string, bits string, variant string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    importable(spark)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1)))
def test_golomb_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    assert (exact_dedup.golomb_values(len(values), *exact_dedup.golomb(values, 1 << 40)) == values).all()


def test_golomb_is_short():
    values = np.unique(np.random.default_rng(1).integers(0, 2**32, 50_000).astype(np.uint64))
    _, unary, rest = exact_dedup.golomb(values, 1 << 32)
    assert 8 * (len(unary) + len(rest)) / len(values) < np.log2(2**32 / len(values)) + 2


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((i, best(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def check(found, rows, digests=True):
    out = found.collect()
    width = 4 if digests else 3
    assert sorted((tuple(r[c] for c in ("id", "keep_id", "group_size", "digest")[:width]) for r in out), key=repr) == sorted((x[:width] for x in brute(rows)), key=repr)
    kept = collections.Counter((r["keep_id"], r["group_size"], r["digest"]) for r in out if r["kept"])
    assert all(r["id"] == r["keep_id"] for r in out if r["kept"])
    assert sum(kept.values()) == len({t or "" for _, t in rows})  # exactly one row of each text stays


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = [None, "", " ", "a", "A", "a ", "é", "é", "\x00", "x" * 3_000_000, "y" * 3_000_000] + ["".join(rng.choice("ab") for _ in range(9)) for _ in range(300)]
    rows = [(k, rng.choice(pool)) for k in range(800)] + [(k + 800, "hot") for k in range(700)]
    return rows + [(5, "twice"), (5, "twice"), (None, "nobody"), (None, "nobody"), (None, "a"), (-3, "hot")]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, *["x"] * 9) for i, t in rows], CLASHING).repartition(7)
    check(exact_dedup.duplicates(df, "num", "body"), rows)


def test_false_suspects_and_many_owners(spark, rows):
    """Two bits more than the owners need: nearly every row is a suspect, and the bytes decide."""
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    check(exact_dedup.duplicates(df, "id", "text", slack=-8, owned=8), rows)
    check(exact_dedup.duplicates(df, "id", "text", owned=6), rows)


def test_equal_digests_of_different_texts(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    check(exact_dedup.duplicates(df, "id", "text", digest=lambda t: F.substring(F.md5(t), 1, 1)), rows, digests=False)


def test_many_senders_of_one_partition(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN", 6)
    check(exact_dedup.duplicates(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", "text"), rows)


def test_normalised(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "id long, text string")
    out = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicates(df, "id", "text", normalise=F.lower).collect()}
    assert out == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}


def test_no_rows(spark):
    assert exact_dedup.duplicates(spark.createDataFrame([], CLASHING), "num", "body").count() == 0


def test_buckets_are_read_without_exchange(spark):
    """Texts reach the byte comparison from their buckets: no exchange below the filter on the bit."""
    from cohortry.llm.store import bucketed

    stored = bucketed(spark.createDataFrame([(k % 5, "t" * k) for k in range(50)], "sender long, text string"), "sender")
    flags = spark.range(5).select(F.col("id").alias("sender"), F.lit(1).alias("bit"))
    plan = stored.hint("merge").join(flags, "sender")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
