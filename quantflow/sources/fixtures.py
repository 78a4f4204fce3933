"""Market-shaped views over the driver tables.

- ``bars_ev``   daily OHLCV per event type from ``events``
- ``bars_li``   daily OHLCV per supplier from ``lineitem`` (close = VWAP)
- ``fills_li``  one fill per ``lineitem`` row
- ``orders_li`` one order per ``lineitem`` row, dated one day before shipping
- ``equity_ord`` daily equity per order priority from ``orders``

Money columns of the driver tables carry two decimals; sums run in DECIMAL so that they are
exact and identical on any engine and in any summation order, then return to DOUBLE.
The bars of ``events`` and the equity of ``orders`` have few keys and are combined before the
shuffle. Most bars of ``lineitem`` are of one row or two: its rows are moved as they are, by
symbol and date, so no input split is sorted and spilled for a combine that saves nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflow.session import dealt
from quantflow.sources.tables import read_table

MONEY = "decimal(18,2)"


def bars_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"))
            .agg(F.min_by("value", "ts").alias("open"),
                 F.max("value").alias("high"),
                 F.min("value").alias("low"),
                 F.max_by("value", "ts").alias("close"),
                 F.count(F.lit(1)).alias("volume")))


def _li_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus",
        F.to_date("l_shipdate").alias("l_shipdate"))


def _priced(li: DataFrame) -> DataFrame:
    return li.withColumn("price", F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")))


def _li_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(_li_dated(spark, sf_dir))


def _li_by_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at the task of their bar."""
    li = _li_dated(spark, sf_dir)
    return dealt(li, li.count(), "l_suppkey", "l_shipdate")  # counted from the files' footers


def bars_li(spark: SparkSession, sf_dir: str, price_scale: float = 1.0) -> DataFrame:
    """Per (supplier, ship date): open = first price by a deterministic row key, close = VWAP."""
    li = _priced(_li_by_bar(spark, sf_dir))
    bars = (li.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("date"))
            .agg(F.min_by("price", F.struct("l_orderkey", "l_linenumber", "l_partkey",
                                             "l_extendedprice", "l_quantity")).alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.sum(F.col("l_extendedprice").cast(MONEY)).alias("__amt"),
                 F.sum("l_quantity").alias("volume")))
    bars = bars.withColumn("close", F.try_divide(F.col("__amt").cast("double"), F.col("volume")))
    out = bars.select("symbol", "date", "open", "high", "low", "close", "volume")
    if price_scale != 1.0:
        out = out.select("symbol", "date",
                         *[(F.col(c) / F.lit(price_scale)).alias(c)
                           for c in ("open", "high", "low", "close")], "volume")
    return out


# Deterministic trade order inside a symbol: (l_orderkey, l_linenumber) alone is not unique.
FILL_ORDER = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
              "quantity", "l_returnflag", "l_linestatus"]


def fills_li(spark: SparkSession, sf_dir: str, price_scale: float = 1.0) -> DataFrame:
    """One fill per lineitem row; ``ord`` is the per-symbol sort key (a struct, no window).

    No global row number: ordering is needed only inside a (account, symbol) fold, which
    sorts by ``ord`` within its partition.
    """
    li = _li_priced(spark, sf_dir)
    out = li.select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("direction"),
        F.col("l_quantity").alias("quantity"),
        (F.col("price") / F.lit(price_scale)).alias("price"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag",
        "l_linestatus")
    return out.select("symbol", "date", "direction", "quantity", "price",
                      F.struct(*[F.col(c) for c in FILL_ORDER]).alias("ord"))


def orders_li(spark: SparkSession, sf_dir: str, price_scale: float = 1.0) -> DataFrame:
    li = _li_priced(spark, sf_dir)
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.date_sub("l_shipdate", 1).alias("date"),
        F.when(F.col("l_linestatus") == "O", "LIMIT").otherwise("MKT").alias("order_type"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("direction"),
        F.col("l_quantity").alias("quantity"),
        (F.col("price") / F.lit(price_scale)).alias("limit_price"),
        F.struct(F.col("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey",
                 "l_extendedprice", "l_quantity", "l_returnflag",
                 "l_linestatus").alias("ord"))


def equity_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series"),
                      F.to_date("o_orderdate").alias("date"))
            .agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("equity")))


def daily_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's stored daily table shape, derived from ``bars_li``:
    ts_code (7 chars), trade_date int yyyymmdd, prices and sizes DECIMAL(18,4)."""
    from pyspark.sql import Window

    from quantflow.functions.exprs import round_even

    lines = read_table(spark, sf_dir, "lineitem").count()  # there are no more bars
    b = dealt(bars_li(spark, sf_dir), lines, "symbol")
    w = Window.partitionBy("symbol").orderBy("date")
    prev = F.lag("close").over(w)

    def dec(c):
        return round_even(c, 4).cast("decimal(18,4)")

    return b.select(
        F.lpad(F.col("symbol").cast("string"), 7, "0").alias("ts_code"),
        F.date_format("date", "yyyyMMdd").cast("int").alias("trade_date"),
        dec(F.col("open")).alias("open"), dec(F.col("high")).alias("high"),
        dec(F.col("low")).alias("low"), dec(F.col("close")).alias("close"),
        dec(prev).alias("pre_close"), dec(F.col("close") - prev).alias("change"),
        dec((F.try_divide(F.col("close"), prev) - 1) * 100).alias("pct_chg"),
        dec(F.col("volume")).alias("vol"),
        dec(F.col("close") * F.col("volume")).alias("amount"))
