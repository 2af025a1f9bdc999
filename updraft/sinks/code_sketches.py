"""Stored sketches of the codes of each period of a price store."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.operators.sketches import LG_CELLS, period_sketches, united
from updraft.operators.upsert import period_of, touched_periods
from updraft.session import is_missing_path
from updraft.sinks.price_store import PriceStore

SKETCH_SCHEMA = "codes binary, rows bigint, first date, last date, period date"


def _start(day: dt.date, unit: str) -> dt.date:
    return day if unit == "day" else day.replace(day=1)


def _next(period: dt.date, unit: str) -> dt.date:
    return period + dt.timedelta(days=1) if unit == "day" else (period + dt.timedelta(days=31)).replace(day=1)


class CodeSketches:
    """One row for each period of ``store`` under ``path/period=...``: what ``data_period`` asks of any range.

    ``refresh`` sketches the periods a batch touches anew, after the batch is in the store; an
    upsert can replace bars, which no sketch forgets. Repeating a refresh changes nothing, so one that
    died is repeated with the same batch. Ranges are answered from whole periods' sketches and from
    the bars of the periods they cut.
    """

    def __init__(self, store: PriceStore, path: str, lg_cells: int = LG_CELLS) -> None:
        self.store = store
        self.path = path.rstrip("/")
        self.lg_cells = lg_cells

    def refresh(self, batch: DataFrame) -> list[dt.date]:
        """Sketch the periods of ``batch`` anew from the store; returns them."""
        unit = self.store.unit
        # Calendar periods, not rows.
        periods = sorted(r["period"] for r in touched_periods(batch.where("date IS NOT NULL"), unit).select("period").collect())
        if periods:
            bars = self.store.read(periods[0], _next(periods[-1], unit))
            fresh = period_sketches(bars.where(period_of(F.col("date"), unit).isin(periods)), unit, self.lg_cells)
            (
                fresh.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("period").parquet(self.path)
            )
        return periods

    def read(self) -> DataFrame:
        try:
            return self.store.spark.read.schema(SKETCH_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return self.store.spark.createDataFrame([], SKETCH_SCHEMA)

    def between(self, since: dt.date, before: dt.date) -> DataFrame:
        """One row (from, to, rows, codes) of the bars from ``since`` on and before ``before``."""
        unit = self.store.unit
        first = _start(since, unit) if _start(since, unit) == since else _next(_start(since, unit), unit)
        end = _start(before, unit)
        if first >= end:
            return united(period_sketches(self.store.read(since, before), unit, self.lg_cells))
        parts = self.read().where((F.col("period") >= F.lit(first)) & (F.col("period") < F.lit(end)))
        for low, high in ((since, first), (end, before)):
            if low < high:
                parts = parts.unionByName(period_sketches(self.store.read(low, high), unit, self.lg_cells))
        return united(parts)
