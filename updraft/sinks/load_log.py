"""The basis of each load into a price store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.operators.adjustment import LOAD_SCHEMA, adjusted_bars, overlap_factors
from updraft.operators.upsert import latest_rows
from updraft.session import is_missing_path, materialize
from updraft.sinks.price_store import PriceStore
from updraft.sources.prices import PRICE_COLUMNS


class LoadLog:
    """Parquet loads under ``path/batch=...``, one folder for each batch, one row for each of its codes.

    A batch is logged before it is upserted, and logged once: when it arrives again after a
    failure in between, the factors found against the bars of that time stay.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{LOAD_SCHEMA}, batch string").parquet(self.path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return self.spark.createDataFrame([], f"{LOAD_SCHEMA}, batch string")

    def record(self, stored: DataFrame, batch: DataFrame, batch_id: str | int) -> None:
        """Log ``batch``, of one row per (code, date), against the bars stored before it."""
        known = self.read().agg(F.max("load").alias("n"), F.bool_or(F.col("batch") == str(batch_id)).alias("seen")).first()
        if known["seen"]:
            return
        # Only the overlap is compared, on the basis of the last load.
        first = batch.agg(F.min("date").alias("first")).first()["first"]
        if first is None:
            return
        overlap = adjusted_bars(stored, self.read()).where(F.col("date") >= F.lit(first))
        factors = overlap_factors(overlap, batch)
        rows = factors.select(F.lit((known["n"] or 0) + 1).cast("bigint").alias("load"), "code", "start", "factor")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def upsert_rebased(store: PriceStore, log: LoadLog, batch: DataFrame, batch_id: str | int, sequence: str) -> None:
    """Log the basis of ``batch``, then upsert it; ``read_adjusted`` gives the bars on the newest basis."""
    rows = materialize(latest_rows(batch.select(*PRICE_COLUMNS, sequence), ["code", "date"], [F.col(sequence)]))
    log.record(store.read(), rows.select(*PRICE_COLUMNS), batch_id)
    store.upsert(rows, batch_id, sequence)


def read_adjusted(store: PriceStore, log: LoadLog) -> DataFrame:
    return adjusted_bars(store.read(), log.read())
