"""Registered queries: scans, sinks and normalisation over the daily table (SRC*, SNK*, NRM*).

``daily_li`` (derived from ``bars_li``) stands in for the stored daily table. Queries that
write do so under the session's shared checkpoint folder, each run in a fresh path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflow.plans.oracle_views import ctes
from quantflow.plans.registry import register
from quantflow.plans.util import rounded
from quantflow.session import checkpoint_dir
from quantflow.sources import fixtures as FX
from quantflow.sources import sinks as SK
from quantflow.sources import tables as TB

DAILY_COLS = ["ts_code", "trade_date", "open", "high", "low", "close", "pre_close", "change",
              "pct_chg", "vol", "amount"]
DEC_COLS = DAILY_COLS[2:]
SQL_DAILY = ", ".join(["ts_code", "trade_date"] + [f"CAST({c} AS DOUBLE) AS {c}" for c in DEC_COLS])


def as_double(df):
    """Decimal outputs leave as DOUBLE (exact: every value has 4 decimals)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def _daily(spark, sf_dir):
    return FX.daily_li(spark, sf_dir)


_STORED: dict[tuple[str, str], str] = {}


def _stored(spark, sf_dir):
    """The daily table as it is stored: Parquet by month, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = _scratch(spark, "stored-daily")
        SK.write_clustered(SK.with_month(_daily(spark, sf_dir)), path, "trade_month", SK.DAILY_KEYS)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _scratch(spark, tag):
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}/{uuid.uuid4().hex}"


D = ctes("daily_li")


@register("src1_csv_scan", f"""WITH {ctes("bars_li")}
SELECT CAST(symbol AS VARCHAR) AS symbol, date, open, high, low, close, volume FROM bars_li""")
def src1(spark, sf_dir):
    path = _scratch(spark, "csv")
    FX.bars_li(spark, sf_dir).write.option("header", True).csv(path)
    return rounded(TB.csv_scan(spark, path))


@register("src2_bar_table_scan", f"WITH {D} SELECT {SQL_DAILY} FROM daily_li", dates=())
def src2(spark, sf_dir):
    return as_double(TB.bar_table_scan(_stored(spark, sf_dir)))


@register("src3_range_symbol_scan", f"""WITH {D}
SELECT {SQL_DAILY} FROM daily_li
WHERE trade_date BETWEEN 19960101 AND 19981231
  AND ts_code IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 7, '0') FROM supplier WHERE s_nationkey < 10)""",
          dates=())
def src3(spark, sf_dir):
    sup = TB.read_table(spark, sf_dir, "supplier").where(F.col("s_nationkey") < 10)
    syms = sup.select(F.lpad(F.col("s_suppkey").cast("string"), 7, "0").alias("ts_code"))
    return as_double(TB.range_symbol_scan(_stored(spark, sf_dir), 19960101, 19981231, syms).select(*DAILY_COLS))


@register("src4_one_day_scan", f"WITH {D} SELECT {SQL_DAILY} FROM daily_li WHERE trade_date = 19980802",
          dates=())
def src4(spark, sf_dir):
    return as_double(TB.one_day_scan(_stored(spark, sf_dir), 19980802).select(*DAILY_COLS))


@register("src5_latest_universe", f"""WITH {D}
SELECT ts_code FROM daily_li WHERE trade_date = (SELECT max(trade_date) FROM daily_li)""", dates=())
def src5(spark, sf_dir):
    return TB.latest_universe(_stored(spark, sf_dir))


@register("src6_distinct_symbols", f"WITH {D} SELECT DISTINCT ts_code FROM daily_li", dates=())
def src6(spark, sf_dir):
    return TB.distinct_symbols(_daily(spark, sf_dir), "ts_code")


@register("src7_symbol_slice", f"WITH {D} SELECT {SQL_DAILY} FROM daily_li WHERE ts_code = '0000001'",
          dates=())
def src7(spark, sf_dir):
    return as_double(TB.symbol_slice(_stored(spark, sf_dir), "0000001", "ts_code").select(*DAILY_COLS))


@register("src8_sql_query", f"""WITH {D}
SELECT ts_code, count(*) AS n_days, CAST(sum(vol) AS DOUBLE) AS vol
FROM daily_li WHERE trade_date BETWEEN 19970101 AND 19971231 GROUP BY ts_code""", dates=())
def src8(spark, sf_dir):
    q = ("SELECT ts_code, count(*) AS n_days, CAST(sum(vol) AS DOUBLE) AS vol FROM {daily} "
         "WHERE trade_date BETWEEN :lo AND :hi AND trade_month BETWEEN :lo DIV 100 AND :hi DIV 100 "
         "GROUP BY ts_code")
    return TB.sql_query(spark, q, {"lo": 19970101, "hi": 19971231}, daily=_stored(spark, sf_dir))


UPSERT_SQL = f"""WITH {D},
base AS (SELECT *, 0 AS prio, 0 AS seq FROM daily_li WHERE trade_date < 20000101),
batch AS (SELECT * REPLACE (CAST(close + 1 AS DECIMAL(18,4)) AS close), 1 AS prio, 1 AS seq
          FROM daily_li WHERE trade_date >= 19990101
          UNION ALL
          SELECT * REPLACE (CAST(close + 2 AS DECIMAL(18,4)) AS close), 1 AS prio, 2 AS seq
          FROM daily_li WHERE trade_date BETWEEN 19990101 AND 19990630),
allr AS (SELECT * FROM base UNION ALL SELECT * FROM batch),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY prio DESC, seq DESC) AS rn
           FROM allr)
SELECT {SQL_DAILY} FROM ranked WHERE rn = 1"""


@register("snk1_keyed_upsert", UPSERT_SQL, dates=())
def snk1(spark, sf_dir):
    daily = _stored(spark, sf_dir)  # its files are by month: the base is written as they are read
    path = _scratch(spark, "daily")
    daily.where(F.col("trade_date") < 20000101).write.partitionBy("trade_month").parquet(path)
    c = F.col("close")
    b1 = daily.where(F.col("trade_date") >= 19990101) \
        .withColumn("close", (c + 1).cast("decimal(18,4)")).withColumn("seq", F.lit(1).cast("long"))
    b2 = daily.where(F.col("trade_date").between(19990101, 19990630)) \
        .withColumn("close", (c + 2).cast("decimal(18,4)")).withColumn("seq", F.lit(2).cast("long"))
    out = SK.keyed_upsert(spark, path, b1.unionByName(b2))
    return as_double(out.select(*DAILY_COLS))


@register("snk2_refresh_job", f"WITH {D} SELECT {SQL_DAILY} FROM daily_li WHERE trade_date = 19980802",
          dates=())
def snk2(spark, sf_dir):
    daily = _daily(spark, sf_dir)

    def landing(table, day):
        return TB.one_day_scan(daily, day).withColumn("seq", F.lit(1).cast("long"))

    root = _scratch(spark, "refresh")
    out = SK.refresh_job(spark, landing, ["daily"], 19980802, root, backup_day="19980802")
    return as_double(out["daily"].select(*DAILY_COLS))


@register("snk2_refresh_tables", f"""WITH {D}
SELECT 'daily' AS tab, ts_code AS k, CAST(trade_date AS BIGINT) AS d,
       CAST(close AS DOUBLE) + CASE WHEN trade_date >= 19980101 THEN 1 ELSE 0 END AS v FROM daily_li
UNION ALL
SELECT 'basic', lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), NULL,
       CAST(CASE WHEN s_suppkey % 2 = 0 THEN -s_nationkey ELSE s_nationkey END AS DOUBLE) FROM supplier""", dates=())
def snk2_tables(spark, sf_dir):
    """Two refreshes of two tables with keys of their own; the second one replaces rows."""
    daily = _daily(spark, sf_dir).select("ts_code", "trade_date", F.col("close").cast("double").alias("close"))
    basic = TB.read_table(spark, sf_dir, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 7, "0").alias("ts_code"), F.col("s_nationkey").cast("double").alias("nation"),
        "s_suppkey")
    seq = F.lit(1).cast("long")
    loads = [{"daily": daily.where("trade_date < 19990101"), "basic": basic.where("s_suppkey % 3 > 0")},
             {"daily": daily.where("trade_date >= 19980101").withColumn("close", F.col("close") + 1),
              "basic": basic.where("s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
              .withColumn("nation", F.when(F.col("s_suppkey") % 2 == 0, -F.col("nation")).otherwise(F.col("nation")))}]
    root = _scratch(spark, "refresh-tables")
    for load in loads:
        out = SK.refresh_tables(spark, root, lambda t: load[t].withColumn("seq", seq),  # noqa: B023
                                {"daily": ["ts_code", "trade_date"], "basic": ["ts_code"]})
    return out["daily"].select(F.lit("daily").alias("tab"), F.col("ts_code").alias("k"), F.col("trade_date").cast("long").alias("d"),
                               F.col("close").alias("v")).unionByName(out["basic"].select(
        F.lit("basic").alias("tab"), F.col("ts_code").alias("k"), F.lit(None).cast("long").alias("d"), F.col("nation").alias("v")))


@register("snk3_create_table", f"WITH {D} SELECT {SQL_DAILY} FROM daily_li", dates=())
def snk3(spark, sf_dir):
    name = f"qf_daily_{uuid.uuid4().hex[:12]}"
    SK.create_table(spark, name, _scratch(spark, "tables"))
    if not SK.table_exists(spark, name):
        raise RuntimeError(f"table {name} was not created")
    daily = SK.with_month(_daily(spark, sf_dir))
    daily.select(*DAILY_COLS, "trade_month").write.insertInto(name)
    return as_double(spark.table(name).select(*DAILY_COLS))


@register("snk4_snapshot_backup", f"WITH {D} SELECT {SQL_DAILY} FROM daily_li", dates=())
def snk4(spark, sf_dir):
    path = SK.snapshot_backup(_daily(spark, sf_dir), _scratch(spark, "backup"), "19990101")
    return as_double(spark.read.parquet(path).select(*DAILY_COLS))


@register("snk5_json_records", f"""WITH {D}
SELECT {SQL_DAILY} FROM daily_li WHERE trade_date BETWEEN 19960101 AND 19981231""", dates=())
def snk5(spark, sf_dir):
    """JSON records of a range scan, parsed back to columns (compare values, not text)."""
    rng = as_double(TB.range_symbol_scan(_stored(spark, sf_dir), 19960101, 19981231).select(*DAILY_COLS))
    # the records are what a client receives; parse them back to columns
    return SK.json_records(rng).select(F.from_json("json", rng.schema).alias("r")).select("r.*")


NRM_SQL = f"""WITH {D}
SELECT CAST(ts_code AS VARCHAR) AS symbol, strptime(CAST(trade_date AS VARCHAR), '%Y%m%d')::DATE AS date,
       CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low,
       CAST(close AS DOUBLE) AS close, CAST(vol AS DOUBLE) AS volume FROM daily_li"""


@register("nrm1_normalise_bars", NRM_SQL)
def nrm1(spark, sf_dir):
    n = TB.normalise_bars(_daily(spark, sf_dir))
    return rounded(as_double(n.select("symbol", "date", "open", "high", "low", "close", "volume")))


@register("nrm2_column_mapping", NRM_SQL)
def nrm2(spark, sf_dir):
    m = {"ts_code": "symbol", "trade_date": "date", "open": "open", "high": "high", "low": "low",
         "close": "close", "vol": "volume"}
    out = TB.column_mapping(_daily(spark, sf_dir), m)
    return rounded(as_double(TB.date_parse(out, "date", "date")))


@register("nrm3_date_parse", f"""WITH {D}
SELECT ts_code, trade_date, strptime(CAST(trade_date AS VARCHAR), '%Y%m%d')::DATE AS date FROM daily_li""")
def nrm3(spark, sf_dir):
    return rounded(TB.date_parse(_daily(spark, sf_dir).select("ts_code", "trade_date")))


FACTORS_SQL = """factors AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         1.0 + CAST(sum(CAST(l_tax AS DECIMAL(10,2))) AS DOUBLE) AS factor
  FROM lineitem GROUP BY 1, 2)"""


def _factors(spark, sf_dir):
    li = TB.read_table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")) \
        .agg((F.lit(1.0) + F.sum(F.col("l_tax").cast("decimal(10,2)")).cast("double")).alias("factor"))


@register("nrm4_price_adjust_qfq", f"""WITH {ctes("bars_li")}, {FACTORS_SQL},
lastf AS (SELECT symbol, arg_max(factor, date) AS lf FROM factors GROUP BY symbol)
SELECT b.symbol, b.date, b.close * (coalesce(f.factor, 1.0) / coalesce(l.lf, 1.0)) AS close
FROM bars_li b LEFT JOIN factors f ON f.symbol = b.symbol AND f.date = b.date
LEFT JOIN lastf l ON l.symbol = b.symbol""")
def nrm4q(spark, sf_dir):
    bars = FX.bars_li(spark, sf_dir).select("symbol", "date", "close")
    out = TB.price_adjust(bars, _factors(spark, sf_dir), "qfq", prices=("close",))
    return rounded(out.select("symbol", "date", "close"))


@register("nrm4_price_adjust_hfq", f"""WITH {ctes("bars_li")}, {FACTORS_SQL}
SELECT b.symbol, b.date, b.close * coalesce(f.factor, 1.0) AS close
FROM bars_li b LEFT JOIN factors f ON f.symbol = b.symbol AND f.date = b.date""")
def nrm4h(spark, sf_dir):
    bars = FX.bars_li(spark, sf_dir).select("symbol", "date", "close")
    out = TB.price_adjust(bars, _factors(spark, sf_dir), "hfq", prices=("close",))
    return rounded(out.select("symbol", "date", "close"))
