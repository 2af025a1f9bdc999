"""Screen results on storage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.config import ScreenConfig, metric_info
from updraft.operators.universe import PUBLISHED_COLUMNS
from updraft.session import is_missing_path

BYTE_ORDER_MARK = "﻿"


def result_name(cfg: ScreenConfig, latest: dt.date | None = None) -> str:
    """Folder name of a CSV result; the nightly one carries no date."""
    if latest is None:
        return f"screen_result{metric_info(cfg).suffix}.csv"
    return f"screen_result_{cfg.metric}_{latest}.csv"


def write_csv(published: DataFrame, path: str) -> None:
    """Write the published columns as CSV in rank order, across many files if large.

    The header's first name starts with a byte-order mark, so that every file
    opens as UTF-8 in spreadsheet programs.
    """
    first, *rest = PUBLISHED_COLUMNS
    (
        published.orderBy("rank")
        .select(F.col(first).alias(BYTE_ORDER_MARK + first), *rest)
        .write.mode("overwrite").csv(path, header=True, encoding="UTF-8", escape='"')
    )


def write_parquet(published: DataFrame, path: str, cfg: ScreenConfig, as_of: dt.date) -> None:
    """Replace the run's partition of a table by metric and base date.

    ``as_of`` is the newest date of all bars. A hit's own last date may be older, so it
    stays a column; a run without hits empties its partition and no other.
    """
    folder = f"{path}/metric={cfg.metric}/data_date={as_of}"
    published.write.mode("overwrite").parquet(folder)


class ResultStore:
    """Screen results kept by (config, newest data date) and reused.

    A result without hits is stored as well: its folder holds an empty file
    with the schema.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, cfg: ScreenConfig, as_of: dt.date, version: int) -> str:
        return f"{self.path}/config={cfg.digest}/as_of={as_of}/version={version}"

    def get(self, cfg: ScreenConfig, as_of: dt.date, version: int = 0) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._folder(cfg, as_of, version))
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return None

    def get_or_compute(
        self,
        cfg: ScreenConfig,
        as_of: dt.date,
        compute: Callable[[], DataFrame],
        version: int = 0,
    ) -> DataFrame:
        """The stored result, else ``compute()`` written and read back.

        ``version`` names the state of the bars, such as an ingest batch
        number; a new one makes old results unreachable.
        """
        stored = self.get(cfg, as_of, version)
        if stored is None:
            compute().write.mode("overwrite").parquet(self._folder(cfg, as_of, version))
            stored = self.get(cfg, as_of, version)
        return stored
