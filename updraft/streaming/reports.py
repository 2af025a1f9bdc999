"""Theme reports read once each: a folder that grows, into a table by date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from updraft.operators.themes import REPORT_SCHEMA
from updraft.session import is_missing_path
from updraft.sources.theme_reports import read_listed

# Fixed value: the columns of the binary file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
STORED_REPORTS = T.StructType([*REPORT_SCHEMA.fields, T.StructField("report_date", T.StringType())])


def ingest_reports(spark: SparkSession, folder: str, path: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Store the reports of ``folder`` that are new since the last run under ``path/report_date=...``.

    The checkpoint remembers the files seen, so only new ones are opened, for their headers too, where
    ``read_theme_reports`` opens all. The query ends when none is left. A batch that died is repeated and replaces
    whole dates. A file that was replaced under its name counts as seen: read it by
    ``read_theme_report`` and give it to ``store_reports``.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "daily_report_*.csv")
        .option("maxFilesPerTrigger", files_at_once).load(folder)
    )

    def store(batch: DataFrame, _: int) -> None:
        store_reports(read_listed(batch.sparkSession, batch), path)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_reports(reports: DataFrame, path: str) -> None:
    """Replace the dates of ``reports`` in the table; others stay."""
    (
        reports.repartition("report_date").sortWithinPartitions("report_date", "rank")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)
    )


def read_stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """The stored reports, of the same columns as ``read_theme_reports``; nothing before the first one."""
    try:
        return spark.read.schema(STORED_REPORTS).parquet(path)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return spark.createDataFrame([], STORED_REPORTS)
