"""Session defaults and table access shared by every operator."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch, and the setting that bounds them.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def session(app: str = "pointloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the time zone fixed; conf entries override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map={**defaults, **conf}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Spark's reader opens it, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in Arrow batches of about BATCH_BYTES, unless it has a bound of its own.

    Without one, a batch is 10,000 rows of any size, and a task's JVM and its Python worker each hold several copies.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and spilled tables that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset (tests, local mode) a local
    folder is chosen and set on the context.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        context.setCheckpointDir(os.path.join(os.environ.get("TMPDIR", "/tmp"), "pointloom-checkpoints"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
