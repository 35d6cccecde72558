import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, _rows
from tidegrid import registry

SMALL = "/root/testdata/sf0.001"
COMPARED = ["series_summary", "drop_backward", "zip_arrays", "pyramid_strings", "query_lod", "sections", "view_ranges",
            "nearest_interval", "merge_intervals", "calendar_rollup", "stream_append"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "series" and df.count() > 0


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", COMPARED)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, res.fetchall())
