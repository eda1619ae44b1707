import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tallyvec.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "item"):
        return _plain(v.item())
    return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("tallyvec", "__spark_entry__.py"):
        os.symlink(f"{root}/{name}", tmp_path / name)
    code = "import sys; sys.modules['tallyvec.llm'] = None; import __spark_entry__ as e; assert 'knn_fraud_score' in e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
