import datetime as dt

import pytest
from pyspark.sql import SparkSession

from updraft.sources.prices import PRICE_SCHEMA


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("updraft-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(warehouse))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FIRST_DAY = dt.date(2026, 1, 5)


def series(code, base, streak, first=FIRST_DAY):
    """Bars on consecutive days: ``base`` volumes on flat falling bars, then
    ``streak`` bars (open, close, volume), oldest first."""
    bars = [(100.0, 99.0, volume) for volume in base] + list(streak)
    return [
        (code, first + dt.timedelta(days=n), open_, close, volume)
        for n, (open_, close, volume) in enumerate(bars)
    ]


@pytest.fixture
def prices(spark):
    return lambda rows: spark.createDataFrame(rows, PRICE_SCHEMA)


def by_code(df):
    return {row["code"]: row for row in df.collect()}
