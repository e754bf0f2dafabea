"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_KEY = "spark.checkpoint.dir"


def local_session(app: str = "thermogrid", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter configures Spark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("THERMOGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master may do without one: there a temporary folder serves.

    Elsewhere each executor would write to a disk of its own, so an unset folder is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(_SCRATCH_KEY, None) or context.getConf().get(_SCRATCH_KEY)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {_SCRATCH_KEY} to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="thermogrid-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return f"{shared_folder(spark)}/thermogrid/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over the session's shuffle partitions before heavy work per row.

    The number is stated, so adaptive execution does not fold a small but expensive stage into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
