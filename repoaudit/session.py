"""Session settings used by tests, the bench and interactive work."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests. On a cluster, use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("repoaudit")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REPOAUDIT_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def freeze(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back from the checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``, shared by all
    executors, so the rows outlive any of them. Only a local session without that
    setting gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="repoaudit-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
