"""The queries whose result SQL can express, against that SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], [str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())
