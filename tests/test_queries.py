"""Every registered query against its SQL, on whole tables: values, names and types."""

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry_points
from conftest import TABLES
from streamlat.plans.catalog import ORACLES, QUERIES

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()

# How DuckDB names the types the results have.
TYPES = {T.LongType(): "BIGINT", T.IntegerType(): "INTEGER", T.StringType(): "VARCHAR",
         T.BooleanType(): "BOOLEAN", T.DoubleType(): "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    result = entry_points.queries()[name](spark, TABLES)
    columns = sorted(result.columns)
    got = sorted(tuple(row[c] for c in columns) for row in result.collect())
    sql = entry_points.oracle_sql()[name]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert got == sorted(want)
    assert got
    described = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: TYPES[f.dataType] for f in result.schema} == described


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
