"""Scans over the driver tables and the stored daily-bar table (SRC*, NRM*)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflow.functions.exprs import yyyymmdd_to_date

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

# Stored daily table (storage types); analytics cast the decimals to double.
DAILY_DDL_SCHEMA = T.StructType([
    T.StructField("ts_code", T.StringType(), False),
    T.StructField("trade_date", T.IntegerType(), False),
    *[T.StructField(c, T.DecimalType(18, 4), True)
      for c in ["open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol", "amount"]],
])

BARS_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.DoubleType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def csv_scan(spark: SparkSession, path: str, schema: T.StructType = BARS_SCHEMA,
             date_format: str | None = None) -> DataFrame:
    """SRC1: header CSV with an explicit schema (never inferred)."""
    reader = spark.read.option("header", True).schema(schema).option("mode", "PERMISSIVE")
    if date_format:
        reader = reader.option("dateFormat", date_format)
    return reader.csv(path)


def bar_table_scan(df: DataFrame) -> DataFrame:
    """SRC2: the stored daily table with its DDL types (decimal storage, int yyyymmdd date)."""
    return df.select(
        F.col("ts_code").cast("string").alias("ts_code"),
        F.col("trade_date").cast("int").alias("trade_date"),
        *[F.col(c).cast(T.DecimalType(18, 4)).alias(c)
          for c in ["open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol",
                    "amount"]],
    )


MONTH_COL = "trade_month"  # partition column of the stored daily table: yyyymm
FEW_SYMBOLS = 1_000_000    # a symbol list up to this length is broadcast (some 30 MB)


def _as_yyyymmdd(d) -> int:
    if d is None:
        return int(_dt.date.today().strftime("%Y%m%d"))
    if isinstance(d, (_dt.date, _dt.datetime)):
        return int(d.strftime("%Y%m%d"))
    return int(_dt.datetime.strptime(str(d), "%Y%m%d").strftime("%Y%m%d"))  # 20241340 raises


def _within(df: DataFrame, date_col: str, start_i: int, end_i: int) -> DataFrame:
    """Rows of an inclusive yyyymmdd range. The column itself is compared, so the bounds reach
    the scan; a table stored by month also gets bounds on its partition column."""
    c = F.col(date_col)
    kind = df.schema[date_col].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        lo = _dt.datetime.strptime(str(start_i), "%Y%m%d")
        after = _dt.datetime.strptime(str(end_i), "%Y%m%d") + _dt.timedelta(days=1)
        out = df.where((c >= F.lit(lo.date()).cast(kind)) & (c < F.lit(after.date()).cast(kind)))
    else:
        out = df.where(c.between(start_i, end_i))
    if MONTH_COL in df.columns:
        out = out.where(F.col(MONTH_COL).between(start_i // 100, end_i // 100))
    return out


def range_symbol_scan(df: DataFrame, start=None, end=None, symbols: Iterable | None = None,
                      date_col: str = "trade_date", symbol_col: str = "ts_code") -> DataFrame:
    """SRC3: inclusive date range and optional symbol list (empty/None = all symbols).

    ``end`` defaults to today, ``start`` to ``end``; start > end raises eagerly. Bounds are
    literals, so the filter reaches the Parquet scan, and a table stored by ``trade_month``
    reads only the months of the range. Symbols are a semi-join, whatever their number; up to
    ``FEW_SYMBOLS`` go to the table's tasks, whose rows then stay where they are read.
    """
    end_i = _as_yyyymmdd(end)
    start_i = _as_yyyymmdd(start) if start is not None else end_i
    if start_i > end_i:
        raise ValueError(f"empty date range: {start_i} comes after {end_i}")
    out = _within(df, date_col, start_i, end_i)
    if isinstance(symbols, DataFrame):
        sym_df = symbols.select(F.col(symbols.columns[0]).alias(symbol_col)).distinct()
        few = sym_df.limit(FEW_SYMBOLS + 1).count() <= FEW_SYMBOLS
        return out.join(F.broadcast(sym_df) if few else sym_df, symbol_col, "left_semi")
    syms = list(symbols) if symbols else []
    if not syms:
        return out
    sym_df = df.sparkSession.createDataFrame([(s,) for s in syms], [symbol_col]).distinct()
    return out.join(F.broadcast(sym_df) if len(syms) <= FEW_SYMBOLS else sym_df, symbol_col, "left_semi")


TODAY = object()  # default marker: an omitted date means today, an explicit None means none


def one_day_scan(df: DataFrame, trade_date=TODAY, date_col: str = "trade_date") -> DataFrame:
    """SRC4: all rows of a landing table for one trade date (default today; None -> none)."""
    if trade_date is None:
        return df.where(F.lit(False))
    if trade_date is TODAY:
        trade_date = _as_yyyymmdd(None)
    day = _as_yyyymmdd(trade_date)
    return _within(df, date_col, day, day)


def latest_universe(df: DataFrame, date_col: str = "trade_date",
                    symbol_col: str = "ts_code") -> DataFrame:
    """SRC5: symbols having a row on the table's latest date.

    The one-row ``max`` is a scalar (bounded size) so the broadcast is safe at any scale. Of a
    table stored by month only the last month is read.
    """
    if MONTH_COL in df.columns:
        df = df.where(F.col(MONTH_COL) == F.lit(df.agg(F.max(MONTH_COL)).first()[0]))
    latest = df.agg(F.max(date_col).alias("__latest"))
    return (df.join(F.broadcast(latest), F.col(date_col) == F.col("__latest"))
            .select(symbol_col))


def distinct_symbols(df: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """SRC6."""
    return df.select(symbol_col).distinct()


def symbol_slice(df: DataFrame, symbol, symbol_col: str = "symbol") -> DataFrame:
    """SRC7."""
    return df.where(F.col(symbol_col) == F.lit(symbol))


def sql_query(spark: SparkSession, sql: str, args: dict | None = None,
              **frames: DataFrame) -> DataFrame:
    """SRC8: SQL with bound parameters (``:name`` markers), never string concatenation;
    DataFrames passed as keywords are referenced as ``{name}`` in the text."""
    return spark.sql(sql, args=args or {}, **frames)


# ---- normalisation (NRM*) -------------------------------------------------------------

RENAME_MAP = {"trade_date": "date", "vol": "volume", "ts_code": "symbol"}


def normalise_bars(df: DataFrame, adjustment: str | None = None,
                   rename: dict | None = None) -> DataFrame:
    """NRM1: canonical column names. Ordering is applied only at output time.

    Any adjustment policy other than raw is handled by ``price_adjust``; an unknown policy
    raises (the reference silently returned nothing).
    """
    if adjustment not in (None, "raw", "RAW"):
        raise ValueError(f"unsupported adjustment {adjustment!r}; use price_adjust()")
    mapping = {k: v for k, v in (rename or RENAME_MAP).items() if k in df.columns}
    out = df.withColumnsRenamed(mapping)
    if "date" in out.columns and isinstance(out.schema["date"].dataType,
                                            (T.IntegerType, T.LongType, T.StringType)):
        out = out.withColumn("date", yyyymmdd_to_date("date"))
    return out


def column_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """NRM2: validated source -> canonical projection; missing source columns raise."""
    missing = [s for s in mapping if s not in df.columns]
    if missing:
        raise ValueError(f"missing source columns: {missing}")
    return df.select([F.col(s).alias(d) for s, d in mapping.items()])


def date_parse(df: DataFrame, c: str = "trade_date", out: str = "date") -> DataFrame:
    """NRM3."""
    return df.withColumn(out, yyyymmdd_to_date(c))


def price_adjust(bars: DataFrame, factors: DataFrame | None = None, policy: str = "raw",
                 keys: Sequence[str] = ("symbol", "date"),
                 prices: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """NRM4 (extension): raw = identity; hfq = price * f; qfq = price * f / latest f.

    ``factors`` is ``adj_factor(symbol, date, factor)``; the latest factor per symbol is a
    grouped ``max_by`` (one row per symbol), joined back on symbol.
    """
    policy = policy.lower()
    if policy == "raw" or factors is None:
        return bars
    if policy not in ("hfq", "qfq"):
        raise ValueError(f"unknown adjustment policy {policy!r}")
    sym = keys[0]
    j = bars.join(factors, list(keys), "left")
    f = F.coalesce(F.col("factor"), F.lit(1.0))
    if policy == "qfq":
        last = factors.groupBy(sym).agg(F.max_by("factor", keys[1]).alias("__last_f"))
        j = j.join(last, sym, "left")
        f = f / F.coalesce(F.col("__last_f"), F.lit(1.0))
    return j.select(*[c for c in bars.columns if c not in prices],
                    *[(F.col(p) * f).alias(p) for p in prices])
