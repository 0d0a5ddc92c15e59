"""Registered queries over whole tables, against their SQL."""

import glob
import os

import pytest

import __spark_entry__ as entry_module

TABLES = "/root/testdata"


def against_sql(spark, size, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(f"{TABLES}/{size}"):
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/{size}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    theirs = con.execute(entry_module.oracle_sql()[name]).fetchdf()
    ours = entry_module.queries()[name](spark, f"{TABLES}/{size}").toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    text = lambda x: "None" if x is None or x != x else f"{float(x):.4f}" if isinstance(x, (float, int)) or hasattr(x, "dtype") else str(x)
    rows = lambda df: sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_sun_geometry_has_all_plants(spark):
    against_sql(spark, "sf0.001", "sun_geometry")


def test_nearest_neighbour_graph_has_all_plants(spark):
    against_sql(spark, "sf0.01", "nearest_neighbour_graph")


def test_nearest_in_time_has_all_readings(spark):
    against_sql(spark, "sf0.001", "nearest_in_time")


def test_window_quality_is_at_the_last_step(spark):
    against_sql(spark, "sf0.001", "window_quality")
