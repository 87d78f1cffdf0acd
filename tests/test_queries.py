"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_every_query_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_records_that_are_missing_lose_no_row(spark, tmp_path):
    """Texts and conversations outnumber candidates: each still has its row."""
    import os

    from vitaespark import workload

    for name in os.listdir(FOLDER):
        if name not in ("customer.parquet", "orders.parquet"):
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    spark.read.parquet(f"{FOLDER}/customer.parquet").where("c_custkey % 3 = 0").write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_custkey % 2 = 0").write.parquet(str(tmp_path / "orders.parquet"))
    report = workload.QUERIES["ground_report"](spark, str(tmp_path))
    assert report.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert report.where("format_issues IS NULL").count() == 0
    plan = workload.QUERIES["dialog_question_plan"](spark, str(tmp_path))
    assert plan.count() == spark.read.parquet(f"{FOLDER}/conversations.parquet").where("role = 'user'").count()
    assert plan.where("question IS NULL").count() == 0
