"""Every registered query at the smallest scale beside its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns, got = rows_of(df.columns, df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in ORACLES:
        rel = db.sql(ORACLES[name])
        assert (columns, got) == rows_of(rel.columns, rel.fetchall())
    else:
        assert sum(got.values()) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def scan_of(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    return [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]


def test_scans_read_only_what_is_used(spark):
    assert set(scan_of(spark, "readable_types")) == {"struct<doc_id:bigint,lang:string>"}
    assert set(scan_of(spark, "questions_per_day")) == {"struct<ts:timestamp_ntz>"}
    assert "struct<doc_id:bigint,text:string>" in scan_of(spark, "page_chunks")
    assert all("text" not in s for s in scan_of(spark, "inconclusive_cases"))
