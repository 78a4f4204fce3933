"""SparkSession construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quantflow", cores: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and bench; on a cluster use the session you are given.

    AQE stays on: it coalesces the small shuffle outputs of per-symbol windows and splits
    skewed join partitions at run time.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    parts = shuffle_partitions or int(os.environ.get("QF_SHUFFLE_PARTITIONS", "8"))
    builder = SparkSession.builder.appName(app)
    if not SparkConf().contains("spark.master"):  # spark-submit's choice stands
        builder = builder.master(f"local[{cores}]")
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QF_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir`` when set.

    Only a local master without one (tests) gets a scratch folder; a cluster must name its own,
    as executors would each write to their own disk.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir() or conf
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="qf-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


TASK_ROWS = 1_000_000  # rows that one task sorts, about


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys, for a sort that stays in memory: in more tasks than the session has
    shuffle partitions where those would take more than ``TASK_ROWS`` of the ``rows`` each."""
    tasks = rows // TASK_ROWS
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, *keys)
    return df.repartition(*keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
