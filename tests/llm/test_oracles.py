"""The queries that have SQL, against DuckDB, and on texts at the edges of their rules."""

import duckdb
import pytest

from martflow.llm import oracles
from martflow.llm import quality_rules as Q
from martflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_quality_sql_at_the_edges(spark):
    texts = [
        None, "", " \n ", "a b c", "x\nx\nx", "one two three four five one two three four five six seven", "é ü\u00a0x # $",
        "same line here\nsame line here\nother", " ".join(f"w{i}" for i in range(40)), "\r\n".join(["a b"] * 6), "word " * 50
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a b c")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(oracles.quality_rules(Q.COVERAGE, Q.LINE_COVERAGE))
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
