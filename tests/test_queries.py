"""Registered queries against their SQL twins in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sitegauge.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"forest_metrics", "forest_confusion", "forest_report", "feature_importance", "forest_scores",
             "forest_predictions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_audit(spark):
    """Share the staged tables between the queries of this module."""
    audit, original = catalog.audit_of(spark, SF), catalog.audit_of
    catalog.audit_of = lambda *_: audit
    yield
    catalog.audit_of = original


def normal(row, names):
    return tuple(repr(round(row[n], 9) + 0.0) if isinstance(row[n], float) else repr(row[n]) for n in names)


def test_every_query_has_a_twin():
    assert set(catalog.queries()) - set(oracle.statements()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    result = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    expected = sorted(normal(dict(zip(columns, row)), names) for row in result.fetchall())
    assert sorted(normal(row, names) for row in df.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
