"""The driver's contract on the smallest tables, and queries against their SQL where DuckDB is there."""

import glob
import os

import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
SAMPLE = ("day_masks", "densified_grid", "quantile_bin_errors", "conformal_bands", "nearest_site", "nearest_in_time", "kwp_registry", "calibration_both", "hourly_medians", "fleet_mean")


def test_names_agree():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    ours, theirs = entry_module.queries()[name](spark, DATA).toPandas(), con.execute(entry_module.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    text = lambda x: "None" if x is None or x != x else f"{float(x):.5f}" if isinstance(x, (float, int)) or hasattr(x, "dtype") else str(x)
    rows = lambda df: sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)
