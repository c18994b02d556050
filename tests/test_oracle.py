"""Every registered query on the smallest tables, against its SQL twin in DuckDB where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    line, same, extra = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert same, "\n".join([line, *extra])


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "chunk_id", "score", "rank"]
