"""Spark session and checkpoint-directory helpers.

Library code never creates its own session: callers pass one in.  These helpers
are for tests, ``bench.py`` and command-line use, plus one rule every iterative
job follows: lineage is cut with ``DataFrame.checkpoint()`` into the shared
folder named by ``spark.checkpoint.dir``.  A private folder is only created when
the session has none (local tests), never when a cluster provides one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "vinterra") -> SparkSession:
    """A local session tuned like the tests expect (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VINTERRA_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    On a cluster the folder is configured (shared storage) and used as is.
    Only when nothing is configured on a ``local`` master a private folder is
    made; any other master raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="vinterra-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def as_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again: the planner then knows
    its size and picks a broadcast or a shuffle join by ``spark.sql.autoBroadcastJoinThreshold``.
    With ``partition_by``, one folder per value, in files of the size that AQE aims at."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable (replicated-storage) checkpoint; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
