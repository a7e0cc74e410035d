from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import comparable

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(result.fetchall(), names)


def test_entry(spark, folder):
    assert contract.entry(spark).count() == 4
