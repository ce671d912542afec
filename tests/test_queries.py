"""Every registered query against its SQL twin on the smallest tables."""

import importlib.util
import math
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL: set[str] = set()

spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def normal(value):
    return f"{value:.6f}" if isinstance(value, float) and not math.isnan(value) else str(value)


def test_every_query_has_sql_or_a_reason():
    from workload import ORACLES, QUERIES

    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.ORACLES)))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    wanted = duck.sql(entry.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    places = [wanted.columns.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in places) for r in wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 40
