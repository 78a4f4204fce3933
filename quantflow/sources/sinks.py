"""Table maintenance: keyed upsert, refresh job, DDL, backup, JSON export (SNK*).

All writes go to paths the caller passes; jobs use the cluster's shared folder (the
session's checkpoint directory) for staging, never a machine-local temp folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflow.session import checkpoint_dir, dealt
from quantflow.sources.tables import DAILY_DDL_SCHEMA

DAILY_KEYS = ("ts_code", "trade_date")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def staging_path(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/staging/{tag}-{uuid.uuid4().hex}"


def with_month(df: DataFrame, date_col: str = "trade_date", out: str = "trade_month") -> DataFrame:
    """Partition column for the daily table: yyyymm from an int yyyymmdd (one partition per
    month keeps files large; a day of bars is one row per symbol)."""
    return df.withColumn(out, (F.col(date_col) / 100).cast("int"))


def write_clustered(df: DataFrame, path: str, partition_col: str, cluster: Sequence[str], mode: str = "overwrite",
                    row_group_bytes: int = 16 << 20) -> None:
    """Write by ``partition_col`` with rows sorted by ``cluster`` inside each file.

    Files hold ranges of the first cluster column in row groups of modest size, with a Parquet
    bloom filter on it: a filter on one of its values skips all but a row group or two of each
    file, by their least and greatest values or by the filter. A large partition is written by
    several tasks (rebalance), a small one by one. ``overwrite`` replaces only the partitions
    that ``df`` has."""
    first = cluster[0]
    (df.hint("rebalance", partition_col).sortWithinPartitions(partition_col, *cluster)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(partition_col)
     .option("parquet.block.size", row_group_bytes).option(f"parquet.bloom.filter.enabled#{first}", "true")
     .option(f"parquet.bloom.filter.adaptive.enabled#{first}", "true").parquet(path))


def keyed_upsert(spark: SparkSession, table_path: str, batch: DataFrame,
                 keys: Sequence[str] = DAILY_KEYS, seq_col: str = "seq",
                 partition_col: str = "trade_month", cluster: Sequence[str] | None = None) -> DataFrame:
    """SNK1: insert-or-replace ``batch`` into the Parquet table at ``table_path`` by ``keys``.

    A new row wins over a stored row with the same key; inside the batch the row with the
    greatest ``seq`` wins (the caller supplies ``seq``: a stable load order). Only the
    partitions the batch touches are read, merged, staged to the shared folder and written
    back with dynamic partition overwrite; other partitions are untouched.
    """
    keys = list(keys)
    b = batch.withColumn("__prio", F.lit(1))
    if seq_col not in b.columns:
        raise ValueError(f"batch needs a '{seq_col}' column (stable load order)")
    if path_exists(spark, table_path):
        cur = spark.read.parquet(table_path)
        missing = sorted(set(cur.columns) - set(b.columns))
        if missing:
            raise ValueError(f"the batch lacks stored columns: {missing}")
        # the batch's months are few; as literals they prune the stored side's partitions
        touched = dict(b.groupBy(partition_col).count().collect())
        old = (cur.where(F.col(partition_col).isin(list(touched)))
               .withColumn("__prio", F.lit(0)).withColumn(seq_col, F.lit(0).cast("long")))
        allrows = dealt(old.unionByName(b), sum(touched.values()) + old.count(), *keys)
    else:
        allrows = b
    w = Window.partitionBy(*keys).orderBy(F.col("__prio").desc(), F.col(seq_col).desc())
    merged = (allrows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
              .drop("__rn", "__prio", seq_col))
    stage = staging_path(spark, "upsert")
    # staged as the tasks have them: the write below moves the rows to their partitions
    merged.write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(merged.schema).parquet(stage)
    write_clustered(staged, table_path, partition_col, cluster or keys)
    _delete(spark, stage)
    return spark.read.parquet(table_path)


def create_table(spark: SparkSession, name: str, location: str,
                 schema: T.StructType = DAILY_DDL_SCHEMA,
                 partition_col: str = "trade_month") -> None:
    """SNK3: CREATE TABLE IF NOT EXISTS ... USING parquet PARTITIONED BY, at ``location``."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}, `{partition_col}` int) "
              f"USING parquet PARTITIONED BY (`{partition_col}`) LOCATION '{location}'")


def table_exists(spark: SparkSession, name: str) -> bool:
    """SNK3 probe."""
    return spark.catalog.tableExists(name)


def snapshot_backup(df: DataFrame, root: str, day: str | None = None) -> str:
    """SNK4: full copy to ``<root>/backup_date=<yyyymmdd>`` (default today); returns the path."""
    import datetime as _dt
    day = day or _dt.date.today().strftime("%Y%m%d")
    path = f"{root.rstrip('/')}/backup_date={day}"
    df.write.mode("overwrite").parquet(path)
    return path


def json_records(df: DataFrame) -> DataFrame:
    """SNK5: one JSON record per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def refresh_tables(spark: SparkSession, root: str, landing: Callable[[str], DataFrame],
                   tables: dict[str, Sequence[str]], backup_day: str | None = None) -> dict[str, DataFrame]:
    """SNK2: refresh several tables, each by its own keys (no date needed), in one commit.

    ``landing(table)`` gives the rows to take in, with a ``seq``. New keys are inserted, known
    ones replaced; readers see all tables before the refresh or all after it. With a backup
    day the committed tables are copied. Returns the committed tables."""
    from quantflow.sources import commits as CM
    CM.upsert_tables(spark, root, {name: (landing(name), keys) for name, keys in tables.items()})
    out = {name: CM.read_committed(spark, root, name) for name in tables}
    if backup_day:
        for name, df in out.items():
            snapshot_backup(df, f"{root.rstrip('/')}/backup/{name}", backup_day)
    return out


def refresh_job(spark: SparkSession, landing: Callable[[str, int], DataFrame],
                tables: Sequence[str], trade_date: int, root: str,
                backup_day: str | None = None) -> dict[str, DataFrame]:
    """SNK2: for each table, take one date from its landing source, upsert it, back it up.

    ``landing(table, trade_date)`` returns that day's rows (with ``seq``). Returns the
    refreshed tables.
    """
    out = {}
    for t in tables:
        day = with_month(landing(t, trade_date))
        path = f"{root.rstrip('/')}/{t}"
        out[t] = keyed_upsert(spark, path, day)
        if backup_day:
            snapshot_backup(out[t], f"{root.rstrip('/')}/backup/{t}", backup_day)
    return out
