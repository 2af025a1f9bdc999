"""Universe files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.operators.universe import normalize_listing, normalize_universe


def _read_text_table(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """All columns as strings (codes have leading zeros), plus file order."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", escape='"', multiLine=True)
    placed = raw.select(
        "*",
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_place"),
    )
    return placed, F.col("_place")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, market) of a CSV file; a byte-order mark is accepted."""
    return normalize_universe(*_read_text_table(spark, path))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, market) of an exchange listing exported as CSV."""
    return normalize_listing(*_read_text_table(spark, path))
