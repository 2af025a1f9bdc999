"""Price tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
PRICE_COLUMNS = PRICE_SCHEMA.fieldNames()
STORED_SCHEMA = T.StructType([*PRICE_SCHEMA.fields, T.StructField("period", T.DateType())])


def empty_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PRICE_SCHEMA)


def read_prices(
    spark: SparkSession,
    path: str,
    since: dt.date | None = None,
    before: dt.date | None = None,
) -> DataFrame:
    """Bars of a store laid out by period (see ``sinks.price_store``).

    ``since`` and ``before`` bound the dates and prune periods. A screen of
    bounded bars misses codes that stopped trading earlier; use
    ``screen_recent_first`` for exact results without shuffling all history.
    """
    prices = spark.read.schema(STORED_SCHEMA).parquet(path)
    if since is not None:
        # A period starts less than a month before any of its dates.
        earliest = since - dt.timedelta(days=31)
        prices = prices.filter(
            (F.col("period") > F.lit(earliest)) & (F.col("date") >= F.lit(since))
        )
    if before is not None:
        prices = prices.filter((F.col("period") < F.lit(before)) & (F.col("date") < F.lit(before)))
    return prices.select(*PRICE_COLUMNS)


def save_bucketed(prices: DataFrame, table: str, buckets: int) -> None:
    """Save bars bucketed and sorted by code.

    Screens of such a table group and window on the stored buckets and shuffle
    no bars at all. Choose ``buckets`` so that one fits a task.
    """
    (
        prices.select(*PRICE_COLUMNS)
        .repartition(buckets, "code")
        .write.bucketBy(buckets, "code").sortBy("code", "date")
        .mode("overwrite").format("parquet").saveAsTable(table)
    )
