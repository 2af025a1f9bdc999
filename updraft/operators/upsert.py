"""Keyed upsert: the later row of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD_UNITS = ("month", "day")


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the last row of each key by ``order``.

    A maximum over a struct rather than a numbered window: copies of one key
    collapse on the map side, so a key holding a third of all rows reaches the
    shuffle as one row per task. Remaining columns close the order.
    """
    values = [c for c in df.columns if c not in keys]
    newest = F.max(
        F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *values)
    ).alias("_row")
    return (
        df.groupBy(*keys)
        .agg(newest)
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    )


def merge_batch(
    stored: DataFrame,
    batch: DataFrame,
    sequence: str,
    keys: Sequence[str] = ("code", "date"),
) -> DataFrame:
    """``stored`` after applying ``batch``; batch rows beat stored rows.

    ``sequence`` is the batch column giving the arrival order inside the batch.
    """
    columns = stored.columns
    both = stored.select(
        *columns, F.lit(0).alias("_batch"), F.lit(None).cast("long").alias("_seq")
    ).unionByName(
        batch.select(*columns, F.lit(1).alias("_batch"), F.col(sequence).cast("long").alias("_seq"))
    )
    return latest_rows(both, keys, [F.col("_batch"), F.col("_seq")]).select(*columns)


def period_of(date: Column, unit: str) -> Column:
    """First day of the ``month`` or ``day`` a date falls into."""
    if unit not in PERIOD_UNITS:
        raise ValueError(f"unit must be one of {PERIOD_UNITS}, got {unit!r}")
    return date if unit == "day" else F.trunc(date, unit)


def touched_periods(batch: DataFrame, unit: str = "month") -> DataFrame:
    """(period, rows) of a batch: the partitions dependents must recompute."""
    return batch.groupBy(period_of(F.col("date"), unit).alias("period")).agg(
        F.count(F.lit(1)).alias("rows")
    )
