"""The registered queries run and agree with their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from skylattice.queries import station

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = ["flagship", "a3_priority_merge", "j3_nearest", "j3b_bilinear", "a20_importance", "d1_training_table_v1", "d2_training_table_v2", "d5_bundle_v2", "w5_gap_fill", "w11_windows_v2", "m1_persistence", "a12_breakdowns_v2", "k7_leaderboard", "i2_forecast"]


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = station.QUERIES[name](spark, SF).toPandas(), con.sql(station.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            assert sorted(x.astype(float).fillna(-9e9)) == pytest.approx(sorted(y.astype(float).fillna(-9e9)), abs=1e-5)
        else:
            assert sorted(map(str, x)) == sorted(map(str, y))
