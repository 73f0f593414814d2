"""Every registered query against its DuckDB form, and none of them vacuous."""

import pytest

from tests.compare import connect, rows
from tracemill.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name in ORACLE:
        want = con.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["pdd", "ear", "oed", "fsd", "ce", "nrr", "bsd", "ccs_exact", "inertia_slope", "ci_index", "pagerank_ici", "gini", "rae", "rt_topology"])
def test_metrics_vary(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert got.drop(columns="doc_id").iloc[:, 0].nunique() >= 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
