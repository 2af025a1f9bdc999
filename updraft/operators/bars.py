"""Bars from trades: open, close and volume per code and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_bars(
    trades: DataFrame,
    *,
    code: Column,
    date: Column,
    price: Column,
    quantity: Column,
    order: Sequence[Column],
) -> DataFrame:
    """Reduce trades to ``prices(code, date, open, close, volume)``.

    Open and close are the prices of the first and last trade by ``order``;
    the price closes the order, so equal trades give one answer. Everything
    is an algebraic aggregate, so a code with a third of all trades is reduced
    on the map side to one row per task and period.

    ``code`` is grouped in its own type and turned into text afterwards:
    integer keys sort and hash faster than their text.
    """
    keyed = trades.select(
        code.alias("code"), date.cast("date").alias("date"),
        F.struct(
            *[c.alias(f"o{i}") for i, c in enumerate(order)], price.alias("price")
        ).alias("trade"),
        quantity.alias("quantity"),
    )
    bars = keyed.groupBy("code", "date").agg(
        F.min("trade")["price"].alias("open"),
        F.max("trade")["price"].alias("close"),
        F.sum("quantity").cast("bigint").alias("volume"),
    )
    return bars.withColumn("code", F.col("code").cast("string"))
