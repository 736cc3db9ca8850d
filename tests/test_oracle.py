"""Every query of the plans against DuckDB, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from martflow.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rel = duck.sql(plans.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want


def test_contract(spark):
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
