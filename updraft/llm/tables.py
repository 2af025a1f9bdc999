"""Reading the given tables and keeping intermediate results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.session import shared_dir

BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "2000"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, given back when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/updraft-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage like ``checkpoint()``, but keeps columns prunable and compressed.
    Every later reader sees the same rows, also after an executor is lost.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_of_id(column: str) -> Column:
    """Unsigned crc32 of an id written as decimal text; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python, once a session, wherever it was started from.

    Where Arrow batches have their default size of 10,000 rows, they are set to BATCH_ROWS:
    texts are long, and a batch is held several times on its way.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    if getattr(context, "_updraft_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="updraft-ship-")) / "updraft.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._updraft_shipped = True
