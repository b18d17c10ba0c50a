"""Every registered query has a plan with stable columns, and its check names the same columns."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 120


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", ["change_stats_A5_C5", "label_mask_R4", "average_precision_E3", "flatten_runs_G1", "overlap_grid_D3", "zonal_by_polygon_R19", "outcome_map_I6", "mask_diff_R9", "change_hotspots_C4_J6"])
def test_spark_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check_queries import TABLES, normalise

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    ref = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in ref.description]
    assert sorted(columns) == sorted(df.columns)
    assert normalise([tuple(r) for r in df.collect()], df.columns) == normalise(ref.fetchall(), columns)
