"""Every registered query against its SQL form on the smallest data, and the shape of the plans."""

import pytest
from oracle import compare, database
from plans import findings

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()
FITS = {"oof_logistic", "oof_forest", "oof_boosting", "feature_importance", "propensity_fit", "propensity_sensitivity", "cohort_logit_coefficients"}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare(spark, con, QUERIES[name], SQL.get(name), FOLDER)
    assert problem in (None, "no rows")


@pytest.mark.parametrize("name", sorted(FITS - {"oof_boosting", "oof_forest"}))
def test_model_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["p", "promo", "sized", "qty_before", "qty_early", "qty_late"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["exposure_profile", "band_join", "range_join_no_key", "caliper_match", "auc_delong", "window_counts", "overlap_or_near", "flag_in_window", "chart_percentile", "concept_flags"])
def test_plans_have_no_cross_join_or_python(spark, name):
    found = findings(QUERIES[name](spark, FOLDER))
    assert not {"cartesian", "nested loop", "python"} & set(found)
