"""Every registered query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from cellframe.catalog import ORACLES, QUERIES
from cellframe.catalog.base import TABLES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canonical(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = canonical(df.columns, df.collect()), canonical(names, cur.fetchall())
    assert len(want) > 0
    assert got == want


def test_only_forests_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"rf_regression_metrics", "rf_class_stats", "experiment_grid", "pdp_surface"}


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["year", "variable", "n_cells", "area_m2"]
    assert out.count() == 14
    assert e.queries().keys() >= e.oracle_sql().keys()
    assert set(QUERIES) <= e.queries().keys()
