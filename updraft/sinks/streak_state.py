"""Streak state of each code, refreshed for the codes a batch touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from updraft.operators.streaks import with_streak
from updraft.operators.upsert import latest_rows, merge_batch
from updraft.session import is_missing_path, materialize
from updraft.sources.prices import PRICE_COLUMNS, PRICE_SCHEMA

STATE_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PRICE_SCHEMA) + ", whole boolean, bucket int"
# Codes looked up by name in the files of the history; more are joined.
NAMED_CODES = 1000


def tails(bars: DataFrame, base_window: int) -> DataFrame:
    """The newest bars of each code: its streak, ``base_window`` bars before and the bar before those.

    Adds ``cut``, true where older bars were left out, and ``shown``: the bars given reach past
    the baseline, so bars before them change nothing.
    """
    marked = with_streak(bars).withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy("code")))
    reach = F.col("streak_len") + base_window
    return marked.where(F.col("age") <= reach + 1).select(
        *PRICE_COLUMNS, (F.col("_bars") > reach + 1).alias("cut"), (F.col("_bars") > reach).alias("shown")
    )


def whole_tails(bars: DataFrame, base_window: int) -> DataFrame:
    """The state of codes of which ``bars`` are all there are."""
    return tails(bars, base_window).select(*PRICE_COLUMNS, (~F.col("cut")).alias("whole"))


class StreakState:
    """Parquet bars under ``path/bucket=...``: of each code the newest ones, as many as a screen looks at.

    A screen of the state equals one of the whole history for any configuration with a base window
    up to ``base_window``, and reads a few bars for each code. ``refresh`` merges a batch into
    the tails of its codes: buckets without such codes keep their files. History is read only for codes whose
    tail no longer shows the beginning of their streak, as after a correction that joins two streaks.

    A refresh that died is repeated with the same batch. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, base_window: int, buckets: int = 64) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.base_window = base_window
        self.buckets = buckets

    def read(self) -> DataFrame:
        """The tails as prices, to be screened."""
        return self._stored().select(*PRICE_COLUMNS)

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATE_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return self.spark.createDataFrame([], STATE_SCHEMA)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("code"), F.lit(self.buckets)).cast("int")

    def rebuild(self, prices: DataFrame) -> None:
        """The state of ``prices``, which are all bars there are."""
        self._write(whole_tails(prices, self.base_window), "static")

    def refresh(self, batch: DataFrame, sequence: str, history: Callable[[], DataFrame]) -> int:
        """Merge ``batch``; gives the number of codes whose history was read.

        ``history`` gives all bars with the batch applied, as ``PriceStore.read`` does.
        """
        batch = materialize(latest_rows(batch.select(*PRICE_COLUMNS, sequence), ["code", "date"], [F.col(sequence)]))
        codes = batch.select("code").distinct().withColumn("bucket", self._bucket())
        # At most ``buckets`` numbers.
        touched = [r["bucket"] for r in codes.select("bucket").distinct().collect()]
        if not touched:
            return 0
        stored = self._stored().where(F.col("bucket").isin(touched))
        own = stored.join(codes.select("code"), "code", "left_semi")
        # A cut tail has older bars behind it: a correction of those changes no figure.
        starts = own.groupBy("code").agg(F.min("date").alias("_first"), F.bool_and("whole").alias("_all"))
        seen = F.coalesce(F.col("_all") | (F.col("date") >= F.col("_first")), F.lit(True))
        joined = batch.join(starts, "code", "left").where(seen)
        merged = merge_batch(own.select(*PRICE_COLUMNS), joined.select(*batch.columns), sequence)
        # New codes have no bars but these.
        flags = starts.select("code", "_all")
        fresh = materialize(
            tails(merged, self.base_window).join(flags, "code", "left").withColumn("_all", F.coalesce("_all", F.lit(True)))
            .select(*PRICE_COLUMNS, (F.col("_all") & ~F.col("cut")).alias("whole"), (F.col("_all") | F.col("shown")).alias("settled"))
        )
        open_codes = materialize(fresh.where("not settled").select("code").distinct())
        count = open_codes.count()
        again = fresh.where("settled").drop("settled")
        if count:
            again = again.unionByName(whole_tails(_of_codes(history(), open_codes, count), self.base_window))
        kept = stored.join(codes.select("code"), "code", "left_anti").select(*PRICE_COLUMNS, "whole")
        self._write(materialize(kept.unionByName(again)), "dynamic")
        return count

    def _write(self, rows: DataFrame, overwrite: str) -> None:
        """Whole buckets; where ``overwrite`` is dynamic, those without rows keep their files."""
        (
            rows.withColumn("bucket", self._bucket())
            .repartition("bucket").sortWithinPartitions("bucket", "code", "date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", overwrite)
            .partitionBy("bucket").parquet(self.path)
        )


def _of_codes(bars: DataFrame, codes: DataFrame, count: int) -> DataFrame:
    """The bars of ``codes``; a few are named, so that sorted files are skipped."""
    if count <= NAMED_CODES:
        return bars.where(F.col("code").isin([r["code"] for r in codes.collect()]))
    return bars.join(codes, "code", "left_semi")
