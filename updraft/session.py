"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Largest counted table that is sent to every task on request.
BROADCAST_ROWS = 100_000


def build_session(app_name: str = "updraft", **conf: str) -> SparkSession:
    """A session with the settings the plans are tuned for.

    Adaptive execution picks partition counts, converts joins to broadcast by
    measured size and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Call-site capture costs more than planning itself on small inputs.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without the
    setting gets a temporary folder; on a cluster that is an error, because a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="updraft-checkpoint-"))
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, given back when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/updraft-{label}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def is_missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because nothing was ever written there."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage and cut its lineage.

    Later stages read the stored rows, so a lost executor costs only its own
    tasks, and decisions taken from the rows stay valid for every reader.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
