"""Price bars on storage, by period, with a restartable upsert."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.operators.upsert import merge_batch, period_of, touched_periods
from updraft.session import is_missing_path, materialize
from updraft.sources.prices import (
    PRICE_COLUMNS,
    PRICE_SCHEMA,
    STORED_SCHEMA,
    empty_prices,
    read_prices,
)

_STAGED, _APPLIED = "staged", "applied"
# Files of the log from which on it is written as one.
LOG_FILES = 64


class PriceStore:
    """Parquet bars under ``path/prices/period=...``, one row per (code, date).

    A period is a month, or a day where days are large enough to be files of
    their own: an upsert rewrites the periods it touches and no others.

    A batch is merged with the periods it touches into ``path/staging``, and
    only the finished staging rows replace those periods. ``path/log`` records
    both steps: a replacement that died half-way is repeated from the staged
    rows before anything else is merged, and an applied batch is not applied
    again. The log is compacted to the last state of each batch, so an upsert
    reads few files however many came before. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, unit: str = "month") -> None:
        self.spark = spark
        self.unit = unit
        path = path.rstrip("/")
        self.prices_path = f"{path}/prices"
        self.staging_path = f"{path}/staging"
        self.log_path = f"{path}/log"

    def read(self, since: dt.date | None = None, before: dt.date | None = None) -> DataFrame:
        try:
            return read_prices(self.spark, self.prices_path, since, before)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return empty_prices(self.spark)

    def version(self) -> int:
        """Number of batches applied so far: names the state of the bars for stored results."""
        log = self._log()
        if log is None:
            return 0
        return log.filter(F.col("step") == _APPLIED).select("batch").distinct().count()

    def upsert(self, batch: DataFrame, batch_id: str | int, sequence: str) -> list[dt.date]:
        """Apply ``batch`` and return the periods it touched.

        Later rows win, inside the batch by ``sequence``. A batch id seen
        before changes nothing and returns no periods.
        """
        batch_id = str(batch_id)
        for logged, applied in self._open_steps(batch_id):
            if not applied:
                self._apply(logged)
            if logged == batch_id:
                return []
        # Periods and staged rows must come from one evaluation of the batch.
        batch = materialize(batch)
        # Calendar periods, not rows.
        touched = touched_periods(batch, self.unit).select("period").collect()
        periods = sorted(r["period"] for r in touched)
        if periods:
            self._stage(batch, batch_id, sequence, periods)
            self._apply(batch_id)
        return periods

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch string, step string").parquet(self.log_path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return None

    def _open_steps(self, batch_id: str) -> list[tuple[str, bool]]:
        """(batch, applied) of the unfinished batch and of ``batch_id``, if logged."""
        log = self._log()
        if log is None:
            return []
        applied = log.groupBy("batch").agg(F.bool_or(F.col("step") == _APPLIED).alias("applied"))
        # With one writer at most one batch is unfinished: two rows at most.
        rows = applied.filter(~F.col("applied") | (F.col("batch") == batch_id)).collect()
        return [(r["batch"], r["applied"]) for r in rows]

    def _record(self, batch_id: str, step: str) -> None:
        row = self.spark.createDataFrame([(batch_id, step)], "batch string, step string")
        row.coalesce(1).write.mode("append").parquet(self.log_path)

    def _compact(self) -> None:
        """Write a log of many files as one: a row for each batch, with its last state.

        The new file is complete before old ones go, and rows that stand twice in
        the log mean the same, so this may die anywhere and is done again later.
        """
        log = self._log()
        old = [] if log is None else log.inputFiles()
        if len(old) < LOG_FILES:
            return
        step = F.when(F.bool_or(F.col("step") == _APPLIED), _APPLIED).otherwise(_STAGED)
        log.groupBy("batch").agg(step.alias("step")).coalesce(1).write.mode("append").parquet(self.log_path)
        self._delete(old)

    def _delete(self, files: list[str]) -> None:
        context = self.spark.sparkContext
        for name in files:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, False)

    def _stage(
        self, batch: DataFrame, batch_id: str, sequence: str, periods: list[dt.date]
    ) -> None:
        merged = merge_batch(self._stored(periods), batch, sequence)
        merged.write.mode("overwrite").parquet(self.staging_path)
        self._record(batch_id, _STAGED)

    def _stored(self, periods: list[dt.date]) -> DataFrame:
        """Stored bars of the given periods; other partitions are not read."""
        try:
            table = self.spark.read.schema(STORED_SCHEMA).parquet(
                self.prices_path
            )
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return empty_prices(self.spark)
        return table.filter(F.col("period").isin(periods)).select(*PRICE_COLUMNS)

    def _apply(self, batch_id: str) -> None:
        """Swap whole periods; rebalancing evens out files and splits hot periods."""
        staged = self.spark.read.schema(PRICE_SCHEMA).parquet(self.staging_path)
        (
            staged.withColumn("period", period_of(F.col("date"), self.unit))
            .hint("rebalance", F.col("period"))
            .sortWithinPartitions("period", "code", "date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("period").parquet(self.prices_path)
        )
        self._record(batch_id, _APPLIED)
        self._compact()
