"""Bars from a stream of trades in event time, with late and repeated trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from updraft.sinks.price_store import PriceStore


def bar_stream(trades: DataFrame, *, code: Column, ts: Column, key: Column, price: Column, quantity: Column, delay: str, period: str = "1 day") -> DataFrame:
    """``prices(code, date, open, close, volume)`` of each window of ``period``, kept in the state store.

    A trade arriving again with its ``key`` within ``delay`` counts once; one older than the watermark, the
    newest event time less ``delay``, is dropped and counted by ``late_rows``. State is bounded by
    the keys and windows within the delay, not by the stream. Windows begin at multiples of ``period`` in UTC.
    """
    timed = trades.select(
        code.cast("string").alias("code"), ts.cast("timestamp").alias("ts"), key.alias("key"), price.alias("price"), quantity.alias("quantity")
    )
    once = timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])
    trade = F.struct("ts", "key", "price")
    # Algebraic aggregates: a hot code is one row per task and window before the shuffle.
    bars = once.groupBy("code", F.window("ts", period).alias("w")).agg(
        F.min(trade)["price"].alias("open"), F.max(trade)["price"].alias("close"), F.sum("quantity").cast("bigint").alias("volume")
    )
    return bars.select("code", F.to_date("w.start").alias("date"), "open", "close", "volume")


def store_bars(bars: DataFrame, store: PriceStore, checkpoint: str) -> StreamingQuery:
    """Upsert the bars that each micro-batch changed into ``store`` until the stream runs dry.

    In update mode a bar is there as soon as its first trade is, and replaced as more come. Batches are named
    by query id and number, so one replayed after a failure is applied once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.upsert(batch.withColumn("_seq", F.lit(0)), f"{query}-{number}", "_seq")

    return (
        bars.writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Trades dropped because they were older than the watermark, over the progress the session keeps
    (``spark.sql.streaming.numRecentProgressUpdates`` micro-batches)."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
