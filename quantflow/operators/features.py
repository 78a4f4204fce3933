"""Rolling per-symbol features (FEA*).

All feature columns share one window spec ``partitionBy(symbol).orderBy(date)``, so Spark
plans one shuffle + one sort for the whole feature set. A symbol's bars are bounded by the
number of trading dates, so a window partition never holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantflow import params as P
from quantflow.sources.sinks import keyed_upsert, write_clustered


def symbol_window(key: str | Sequence[str] = "symbol", order: str | Sequence[str] = "date"):
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*orders)


def last_n(w, n: int):
    return w.rowsBetween(-(n - 1), Window.currentRow)


def last_write_wins(df: DataFrame, keys: Sequence[str] = ("symbol", "date"),
                    order_desc: Sequence[str] = ("seq",)) -> DataFrame:
    """FEA5 / SNK1 core: keep one row per key, the one with the greatest ``order_desc``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_desc])
    return (df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
            .drop("__rn"))


def return_1d(price: str = "close", key="symbol", order="date"):
    """FEA3: simple return ``price / prev - 1`` (pandas ``pct_change``); NULL on the first
    row and on a zero previous price."""
    w = symbol_window(key, order)
    prev = F.lag(price).over(w)
    return F.try_divide(F.col(price), prev) - 1


def with_features(bars: DataFrame, lookbacks: Mapping[str, int] | None = None,
                  key: str = "symbol", order: str = "date", price: str = "close",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """FEA1-4, FEA6: ``close``, one column per lookback, ``Return_1d``.

    A lookback whose name contains "MA" is a moving average of the last N prices; otherwise,
    one containing "Volatility" is the sample std (ddof 1) of the last N returns. Each is NULL
    until N non-null inputs are in the frame (pandas ``rolling(N)`` default).
    """
    lookbacks = dict(P.DEFAULT_LOOKBACKS if lookbacks is None else lookbacks)
    w = symbol_window(key, order)
    base_cols = list(keep) if keep is not None else [key, order]
    df = bars.select(*base_cols, F.col(price).alias("close")) if price != "close" or keep \
        else bars.select(key, order, "close")
    df = df.withColumn("Return_1d", return_1d("close", key, order))
    cols = []
    for name, n in lookbacks.items():
        frame = last_n(w, n)
        if "MA" in name:
            cols.append(F.when(F.count("close").over(frame) >= n,
                               F.avg("close").over(frame)).alias(name))
        elif "Volatility" in name:
            cols.append(F.when(F.count("Return_1d").over(frame) >= n,
                               F.stddev_samp("Return_1d").over(frame)).alias(name))
    out_cols = [c for c in df.columns if c != "Return_1d"]
    return df.select(*out_cols, *cols, "Return_1d")


def feature_map(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """FEA4 exchange form: ``features`` as MAP<STRING, DOUBLE> (NULL values kept)."""
    kv = []
    for n in names:
        kv += [F.lit(n), F.col(n).cast("double")]
    return features.withColumn("features", F.create_map(*kv))


def training_buffer(features: DataFrame, n: int, cols: Sequence[str],
                    key: str = "symbol", order: str = "date") -> DataFrame:
    """FEA7: the last ``n`` feature rows per symbol as an array of structs (bounded by n)."""
    w = last_n(symbol_window(key, order), n)
    return features.withColumn("buffer", F.collect_list(F.struct(*cols)).over(w))


def latest_price(bars: DataFrame, key: str = "symbol", order: str = "date",
                 price: str = "close") -> DataFrame:
    """FEA9 batch form: last known close per symbol (partial aggregate, no sort)."""
    return bars.groupBy(key).agg(F.max_by(price, order).alias("last_price"),
                                 F.max(order).alias("last_date"))


def write_feature_store(features: DataFrame, path: str, mode: str = "append") -> None:
    """FEA8: features stored as Parquet by month of ``date``, sorted by symbol and date inside
    each file (``write_clustered``), so reads by date skip months and reads by symbol row groups.

    ``append`` takes (symbol, date) rows in: new ones are added and known ones replaced, in the
    months the batch has, so the same batch twice leaves the store as after once.
    ``overwrite`` replaces the months that ``features`` has. A large month is written by several tasks.
    """
    rows = features.withColumn("month", F.date_format("date", "yyyy-MM"))
    if mode == "append":
        batch = rows.dropDuplicates(["symbol", "date"]).withColumn("seq", F.lit(1).cast("long"))
        keyed_upsert(features.sparkSession, path, batch, ("symbol", "date"), partition_col="month")
    else:
        write_clustered(rows, path, "month", ("symbol", "date"), mode)


def read_feature_store(spark, path: str, symbols=None, start=None, end=None) -> DataFrame:
    """FEA8: stored rows of the given symbols and of dates from ``start`` to ``end``."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("month") >= F.lit(str(start)[:7])) & (F.col("date") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("month") <= F.lit(str(end)[:7])) & (F.col("date") <= F.lit(end)))
    if symbols:
        df = df.where(F.col("symbol").isin(list(symbols)))
    return df.drop("month")
