"""Send-once ledger of notifications.

One row per sent notification: (metric, data_date, sent_at). The ledger is
kept per metric, so a turnover notice may follow a volume notice of the same
date. ``SendLog`` adds the claim before a send, for runs that may die between
a send and its record.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from updraft.session import is_missing_path

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("data_date", T.DateType()),
        T.StructField("sent_at", T.TimestampNTZType()),
    ]
)


def last_sent(ledger: DataFrame) -> DataFrame:
    """(metric, data_date) of the newest notification of each metric."""
    return ledger.groupBy("metric").agg(
        F.max(F.struct("sent_at", "data_date"))["data_date"].alias("data_date")
    )


def pending(candidates: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Candidates whose data date differs from the one last sent.

    Candidates without a data date are always pending, as is everything under
    ``force``.
    """
    if force:
        return candidates
    return candidates.join(last_sent(ledger), ["metric", "data_date"], "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def record_sent(sent: DataFrame, path: str, sent_at: dt.datetime) -> None:
    """Append sent (metric, data_date) rows; call after the send succeeded."""
    stamp = F.lit(sent_at.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = sent.filter(F.col("data_date").isNotNull()).select(
        "metric", "data_date", stamp.alias("sent_at")
    )
    rows.distinct().write.mode("append").parquet(path)


STEP_SCHEMA = "metric string, data_date date, at timestamp_ntz, attempt string, step string"
_CLAIMED, _CONFIRMED, _RELEASED = "claimed", "confirmed", "released"


class SendLog:
    """Notifications as attempts under ``path/attempt=.../step=...``: claimed, then confirmed.

    A notification is claimed before it is sent and confirmed after. A run that dies in between leaves
    an open claim: no later attempt takes it, so nothing is sent twice unnoticed, and ``in_doubt`` names
    it, so nothing is lost. Whoever has looked whether it went out confirms or releases the attempt.
    Each step of an attempt is written once; repeating one with the same key changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(STEP_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return self.spark.createDataFrame([], STEP_SCHEMA)

    def sent(self) -> DataFrame:
        """The confirmed notifications as a ledger."""
        done = self.read().where(F.col("step") == _CONFIRMED)
        return done.select("metric", "data_date", F.col("at").alias("sent_at"))

    def in_doubt(self) -> DataFrame:
        """(metric, data_date, attempt, at) of claims neither confirmed nor released."""
        steps = self.read()
        ended = steps.where(F.col("step") != _CLAIMED).select("attempt").distinct()
        claims = steps.where(F.col("step") == _CLAIMED).join(ended, "attempt", "left_anti")
        return claims.select("metric", "data_date", "attempt", "at")

    def claim(self, candidates: DataFrame, attempt: str, at: dt.datetime, force: bool = False) -> DataFrame:
        """Claim what is pending and in nobody's claim; returns the (metric, data_date) rows to send now.

        An attempt that claims again gets the rows it claimed before, while they are open.
        """
        if not self._has(attempt, _CLAIMED):
            asked = candidates.select("metric", "data_date").distinct()
            held = self.in_doubt().select(F.col("metric").alias("_m"), F.col("data_date").alias("_d"))
            same = F.col("metric").eqNullSafe(F.col("_m")) & F.col("data_date").eqNullSafe(F.col("_d"))
            self._write(pending(asked, self.sent(), force).join(held, same, "left_anti"), attempt, _CLAIMED, at)
        return self.in_doubt().where(F.col("attempt") == attempt).select("metric", "data_date")

    def confirm(self, attempt: str, at: dt.datetime) -> None:
        """Record that everything the attempt claimed was sent."""
        self._end(attempt, _CONFIRMED, at)

    def release(self, attempt: str, at: dt.datetime) -> None:
        """Record that nothing the attempt claimed was sent: it may be claimed again."""
        self._end(attempt, _RELEASED, at)

    def _end(self, attempt: str, step: str, at: dt.datetime) -> None:
        if not self._has(attempt, _CLAIMED):
            raise ValueError(f"attempt {attempt!r} claimed nothing")
        other = _RELEASED if step == _CONFIRMED else _CONFIRMED
        if self._has(attempt, other):
            raise ValueError(f"attempt {attempt!r} is {other} already")
        if not self._has(attempt, step):
            claims = self.read().where((F.col("attempt") == attempt) & (F.col("step") == _CLAIMED))
            self._write(claims.select("metric", "data_date"), attempt, step, at)

    def _folder(self, attempt: str, step: str) -> str:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", attempt):
            raise ValueError(f"attempt key {attempt!r}: a letter, then letters, digits, _ and -")
        return f"{self.path}/attempt={attempt}/step={step}"

    def _has(self, attempt: str, step: str) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder(attempt, step)}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def _write(self, rows: DataFrame, attempt: str, step: str, at: dt.datetime) -> None:
        stamp = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
        # Metrics and dates: a handful of rows.
        rows.select("metric", "data_date", stamp.alias("at")).coalesce(1).write.mode("overwrite").parquet(self._folder(attempt, step))
