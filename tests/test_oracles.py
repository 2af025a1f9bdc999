"""Every query against its SQL, on the driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from updraft.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def canonical(rows, columns):
    def cell(value):
        return "nan" if isinstance(value, float) and math.isnan(value) else value
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(cursor.fetchall(), columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Cartesian", "BroadcastNestedLoop", "Python", "Pandas"):
        assert unwanted not in plan


def test_entry(spark):
    assert driver.entry(spark).count() > 0
