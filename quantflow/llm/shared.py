"""Helpers that the operators share: the run folder, bounded Arrow chunks, worker state."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflow.session import checkpoint_dir

CHUNK_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to ``BATCH_BYTES``: ten thousand whole texts, the usual
    batch, fill tens of MB in the executor and again in its Python worker. A smaller limit that
    the session has already stays."""
    held = spark.conf.get(BATCH_SETTING, "64m")
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held)
    if limit > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder for one run below the shared checkpoint folder."""
    bound_batches(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, so a
    lost executor repeats no work before it, and later jobs see one fixed set of rows."""
    path = f"{folder}/{name}"
    spark, schema = df.sparkSession, df.schema
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    # what the write shuffled is not read again: let Spark's cleaner see that now, not when the
    # driver next happens to collect its garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop_staged(spark: SparkSession, folder: str, name: str = "") -> None:
    """Delete staged rows that nothing will read again."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def worker_state(key, make: Callable):
    """A value made once per Python worker process and kept for its later tasks."""
    store = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    held = store.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


class Generations:
    """A bounded cache of two generations: when the young one is full it becomes the old one,
    so what is looked up often survives and what came once goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get_all(self, keys: list) -> list:
        young, old, out = self.young, self.old, []
        for k in keys:
            v = young.get(k)
            if v is None and (v := old.get(k)) is not None:
                young[k] = v
            out.append(v)
        return out

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


def byte_offsets(column: pa.Array) -> np.ndarray:
    """Start offsets (n + 1) of a string or binary array in its own data buffer."""
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind, count=len(column) + 1 + column.offset)
    return raw[column.offset:].astype(np.int64)


def chunks(batches: Iterable[pa.RecordBatch], column: str | int,
           most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``most`` bytes at most; a
    longer text forms a run of its own. After each batch the worker hands free memory back."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = byte_offsets(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end
        hand_back()


def hand_back() -> None:
    """Return memory that was freed to the system: workers live on between tasks, and what the
    allocators keep of one stage is missing for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(worker_state("libc", lambda: ctypes.CDLL(None)), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string array as one run of UTF-8 bytes, and their offsets (n + 1) in it.
    Null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    at = byte_offsets(column)
    if len(column) == 0 or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
    return data, at - at[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of one byte run as an Arrow binary array, without copying them one by one."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def spread(n: int, most: int) -> int:
    """Number of parts of at most ``most`` that hold ``n``."""
    return max(1, -(-n // most))


BITMAP_WORDS = 1 << 17


def likely_in(df: DataFrame, keys: DataFrame, key: str, seed: int = 5) -> DataFrame:
    """``df`` with a boolean ``_likely``: false only for rows whose ``key`` is surely not among
    ``keys``. A bitmap of hashes of fixed size (at most 2^17 rows of 64 bits, 2 MB) is broadcast,
    so that most rows without a partner need no shuffle; exact joins must follow."""
    bit = F.xxhash64(F.col(key), F.lit(seed))
    word, mask = F.pmod(bit, F.lit(BITMAP_WORDS)), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{key}`, {seed}), 20), 64) as int))")
    bitmap = keys.where(F.col(key).isNotNull()).select(word.alias("_word"), mask.alias("_mask")) \
        .groupBy("_word").agg(F.bit_or("_mask").alias("_mask")).collect()
    table = df.sparkSession.createDataFrame([(r["_word"], r["_mask"]) for r in bitmap], "_word bigint, _bits bigint")
    marked = df.withColumn("_word", word).join(F.broadcast(table), "_word", "left")
    likely = F.coalesce(mask.bitwiseAND(F.col("_bits")) != 0, F.lit(False))
    return marked.withColumn("_likely", likely & F.col(key).isNotNull()).drop("_word", "_bits")


def likely_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The likely rows of ``df`` by two bitmaps: with millions of keys one alone lets many others pass."""
    for seed in (5, 7):
        df = likely_in(df, keys, key, seed).where("_likely").drop("_likely")
    return df
