"""Dated theme reports as CSV files, one for each date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_theme_reports(reports: DataFrame, folder: str) -> None:
    """Write ``daily_report_<date>.csv`` for each ``report_date``, rows by rank.

    Reports of the same dates are replaced, those of others stay. Spark writes the
    rows; only the files, one for each date, are named afterwards.
    """
    staged = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    (
        reports.repartition("report_date").sortWithinPartitions("report_date", "rank")
        # One file for each date, also where the session limits the rows of a file.
        .write.option("maxRecordsPerFile", 0).partitionBy("report_date").csv(staged, header=True, encoding="UTF-8", escape='"')
    )
    context = reports.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(context._jsc.hadoopConfiguration())
    for day in files.listStatus(path(staged)):
        name, is_date, date = day.getPath().getName().partition("=")
        if not is_date:
            continue
        target = path(f"{folder.rstrip('/')}/daily_report_{date}.csv")
        for part in files.listStatus(day.getPath()):
            files.delete(target, False)
            files.rename(part.getPath(), target)
    files.delete(path(staged), True)
