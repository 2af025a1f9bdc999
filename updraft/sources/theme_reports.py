"""Dated theme reports: ``daily_report_<date>.csv`` in one folder."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from updraft.functions.text import missing_to_null
from updraft.operators.themes import REPORT_SCHEMA
from updraft.session import is_missing_path

_NAME = r"daily_report_([^/]*)\.csv$"


def _cell(field: T.StructField) -> Column:
    text = F.col(f"`{field.name}`")
    text = missing_to_null(text)
    if isinstance(field.dataType, T.StringType):
        return text.alias(field.name)
    number = text.try_cast("boolean" if field.dataType.typeName() == "boolean" else "double")
    # Whole numbers may come as "3.0" when the column has gaps.
    return number.cast(field.dataType).alias(field.name)


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """The files as rows (path, content); content is read only where it is asked for."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return None


def _files_by_header(listing: DataFrame) -> list[list[str]]:
    """Paths of the files with rows of columns, those of one header together."""
    header = F.regexp_extract(F.decode("content", "UTF-8"), r"\A\uFEFF?([^\r\n]*)", 1)
    groups = (
        listing.select("path", header.alias("header")).filter("header <> ''")
        .groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    )
    # One path for each report day, under a few headers.
    return [row["paths"] for row in groups.orderBy("header").collect()]


def _raw_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.csv(
        paths, header=True, encoding="UTF-8", enforceSchema=False, escape='"', multiLine=True
    )


def _report_date() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), _NAME, 1)


def _read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = _raw_files(spark, paths)
    cells = [
        _cell(f) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in REPORT_SCHEMA.fields
    ]
    return raw.select(*cells, _report_date().alias("report_date"))


def _malformed_in(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(report_date, column, cell) of the cells that hold a text but not a value of their column."""
    raw = _raw_files(spark, paths)
    typed = [f for f in REPORT_SCHEMA.fields if f.name in raw.columns and not isinstance(f.dataType, T.StringType)]
    if not typed:
        return raw.select(_report_date().alias("report_date"), F.lit("").alias("column"), F.lit("").alias("cell")).limit(0)
    texts = {f.name: missing_to_null(F.col(f"`{f.name}`")) for f in typed}
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.when(_cell(f).isNull(), texts[f.name]).alias("cell")) for f in typed
    ])
    return raw.select(_report_date().alias("report_date"), F.inline(cells)).where("cell IS NOT NULL")


def read_listed(spark: SparkSession, listing: DataFrame | None) -> DataFrame:
    """The reports of the files listed as (path, content)."""
    groups = [] if listing is None else _files_by_header(listing)
    if not groups:
        schema = T.StructType([*REPORT_SCHEMA.fields, T.StructField("report_date", T.StringType())])
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [_read_files(spark, paths) for paths in groups])


def _read(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return read_listed(spark, _listing(spark, folder, pattern))


def theme_report_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates with a report file, newest first, one without rows included; no file is opened."""
    listing = _listing(spark, folder, "daily_report_*.csv")
    if listing is None:
        return spark.createDataFrame([], "report_date string")
    dates = listing.select(F.regexp_extract("path", _NAME, 1).alias("report_date"))
    return dates.distinct().orderBy(F.col("report_date").desc())


def read_theme_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All reports as one frame with ``report_date`` from the file name.

    Columns are found by header, and readers of few columns parse only those.
    Files whose headers differ are read apart, and a column a file lacks is
    NULL in its rows. A missing folder, or one without reports, gives an empty
    frame of the same schema.
    """
    return _read(spark, folder, "daily_report_*.csv")


def read_theme_report(spark: SparkSession, folder: str, date: str | dt.date) -> DataFrame:
    """One day's report; other files are not opened."""
    return _read(spark, folder, f"daily_report_{date}.csv")


def malformed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(report_date, column, cells, example): what ``read_theme_reports`` turns into NULL for not being a number or flag.

    Cells that are empty or stand for a missing value are not malformed. ``example`` is the least such text.
    """
    listing = _listing(spark, folder, "daily_report_*.csv")
    groups = [] if listing is None else _files_by_header(listing)
    if not groups:
        return spark.createDataFrame([], "report_date string, column string, cells bigint, example string")
    found = reduce(DataFrame.unionByName, [_malformed_in(spark, paths) for paths in groups])
    return found.groupBy("report_date", "column").agg(F.count(F.lit(1)).alias("cells"), F.min("cell").alias("example"))
