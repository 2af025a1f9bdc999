"""Quotes arriving as a stream, upserted batch by batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from updraft.operators.ingest import clean_quotes
from updraft.sinks.price_store import PriceStore


def ingest_stream(
    quotes: DataFrame,
    store: PriceStore,
    sequence: str,
    checkpoint: str,
    now: dt.datetime | Column,
    on_batch: Callable[[list[dt.date]], None] | None = None,
) -> StreamingQuery:
    """Clean a quote stream and upsert it into ``store`` until it runs dry.

    Quotes carry ``code, date, open, close, volume`` and a ``sequence`` column.
    The stream keeps no state: a late correction is just another upsert of its
    key. Batches are named by query id and number, so one replayed after a
    failure is applied once. ``on_batch`` receives the touched periods.
    """
    cleaned = clean_quotes(quotes, now)

    def apply(batch: DataFrame, batch_number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        periods = store.upsert(batch, f"{query}-{batch_number}", sequence)
        if on_batch is not None:
            on_batch(periods)

    return (
        cleaned.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
