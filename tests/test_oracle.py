"""Every registered query runs on the smallest tables; those with SQL must agree with DuckDB."""

import pytest

import __spark_entry__ as entry
from cohortia.catalog.check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_keys():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) > 0
    assert df.count() > 0


CUT = ["c_index", "roc_auc", "pr_auc", "feature_ranking", "kaplan_meier", "logrank", "spearman_by_feature", "martingale_residuals"]


@pytest.mark.parametrize("name", CUT)
def test_against_sql_with_many_buckets(spark, sf, con, name, monkeypatch):
    from cohortia.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 40)
    assert compare(QUERIES[name](spark, sf), con, SQL[name]).startswith("ok")
