"""Registered queries: features, rule/probability signals, event filters (FEA, SIG, FLT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflow.operators import events as EV
from quantflow.operators import features as FE
from quantflow.operators import signals as SG
from quantflow.plans.oracle_views import (BARS_EV, BARS_LI, FILLS_LI, features_sql,
                                          rule_signal_sql)
from quantflow.plans.registry import register
from quantflow.plans.util import rounded
from quantflow.session import checkpoint_dir
from quantflow.sources import fixtures as FX

FEAT_ROUND = {"Volatility20": 8}
R = "round_even"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars -> FEA1-4 -> SIG1 (the minimum end-to-end slice)."""
    bars = FX.bars_ev(spark, sf_dir)
    out = SG.rule_signal(FE.with_features(bars))
    return rounded(out, FEAT_ROUND)


FLAGSHIP_SQL = f"""WITH {BARS_EV}, {features_sql('bars_ev')}, {rule_signal_sql('feat')}
SELECT symbol, date, close, MA5, MA10,
       {R}(Volatility20, 8) AS Volatility20, Return_1d, signal
FROM sig"""

register("sig1_rule_signal_ev", FLAGSHIP_SQL, bench=True)(flagship)


def _feat_li(spark, sf_dir, lookbacks=None):
    return FE.with_features(FX.bars_li(spark, sf_dir), lookbacks)


@register("fea1_moving_average", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, MA5, MA10 FROM feat""")
def fea1(spark, sf_dir):
    return rounded(_feat_li(spark, sf_dir).select("symbol", "date", "MA5", "MA10"), FEAT_ROUND)


@register("fea2_rolling_volatility", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, {R}(Volatility20, 8) AS Volatility20 FROM feat""")
def fea2(spark, sf_dir):
    return rounded(_feat_li(spark, sf_dir).select("symbol", "date", "Volatility20"), FEAT_ROUND)


@register("fea3_return_1d", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, Return_1d FROM feat""")
def fea3(spark, sf_dir):
    return rounded(_feat_li(spark, sf_dir).select("symbol", "date", "Return_1d"), FEAT_ROUND)


@register("fea4_feature_row", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, close, MA5, MA10,
       {R}(Volatility20, 8) AS Volatility20, Return_1d FROM feat""",
          bench=True)
def fea4(spark, sf_dir):
    return rounded(_feat_li(spark, sf_dir), FEAT_ROUND)


@register("fea5_last_write_wins", f"""WITH {FILLS_LI}
SELECT symbol, date, price FROM (
  SELECT symbol, date, price,
         row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS rn
  FROM fills_li) WHERE rn = 1""")
def fea5(spark, sf_dir):
    fills = FX.fills_li(spark, sf_dir)
    out = FE.last_write_wins(fills, ("symbol", "date"), ("ord",))
    return rounded(out.select("symbol", "date", "price"))


CUSTOM_LOOKBACKS = {"MA3": 3, "MA20": 20, "Volatility5": 5, "Volatility10": 10}


@register("fea6_custom_lookbacks", f"""WITH {BARS_LI}, {features_sql('bars_li', CUSTOM_LOOKBACKS)}
SELECT symbol, date, MA3, MA20,
       {R}(Volatility5, 8) AS Volatility5, {R}(Volatility10, 8) AS Volatility10 FROM feat""")
def fea6(spark, sf_dir):
    f = _feat_li(spark, sf_dir, CUSTOM_LOOKBACKS)
    return rounded(f.select("symbol", "date", "MA3", "MA20", "Volatility5", "Volatility10"),
                   {"Volatility5": 8, "Volatility10": 8})


BUFFER_N = 30


@register("fea7_training_buffer", f"""WITH {BARS_LI}, b AS (
  SELECT symbol, date, list(date) OVER w AS days, list(close) OVER w AS closes FROM bars_li
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {BUFFER_N - 1} PRECEDING))
SELECT symbol, date, CAST(len(days) AS INTEGER) AS n_rows, days[1] AS first_date,
       array_to_string([strftime(d, '%Y%m%d') FOR d IN days], ' ') AS days,
       list_reduce(closes, lambda x, y: x * 0.5 + y) AS close_fold
FROM b""", dates=("date", "first_date"))
def fea7(spark, sf_dir):
    """One row per bar: its buffer's size, first date, dates and closes in order (the closes as
    a fold that depends on their order)."""
    buf = FE.training_buffer(FX.bars_li(spark, sf_dir), BUFFER_N, ["date", "close"])
    return rounded(buf.select(
        "symbol", "date", F.size("buffer").alias("n_rows"), F.get("buffer", F.lit(0))["date"].alias("first_date"),
        F.array_join(F.transform("buffer", lambda x: F.date_format(x["date"], "yyyyMMdd")), " ").alias("days"),
        F.aggregate("buffer", F.lit(0.0), lambda a, x: a * 0.5 + x["close"]).alias("close_fold")))


@register("fea8_feature_store", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, close, MA5, MA10,
       {R}(Volatility20, 8) AS Volatility20, Return_1d FROM feat""")
def fea8(spark, sf_dir):
    """Write the feature history partitioned by date to the shared folder, read it back."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/feature_store/{uuid.uuid4().hex}"
    FE.write_feature_store(_feat_li(spark, sf_dir), path, mode="overwrite")
    back = FE.read_feature_store(spark, path)
    return rounded(back.select("symbol", "date", "close", "MA5", "MA10", "Volatility20",
                               "Return_1d"), FEAT_ROUND)


@register("fea8_feature_slices", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, close, MA5, MA10, {R}(Volatility20, 8) AS Volatility20, Return_1d FROM feat
WHERE symbol IN (1, 7, 12) AND date BETWEEN DATE '1994-03-15' AND DATE '1997-09-02'""")
def fea8_slices(spark, sf_dir):
    """The store filled by two overlapping appends, read by symbols and dates."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/feature_store/{uuid.uuid4().hex}"
    f = _feat_li(spark, sf_dir)
    FE.write_feature_store(f.where("date < '1996-07-01'"), path)
    FE.write_feature_store(f.where("date >= '1995-12-20'"), path)
    back = FE.read_feature_store(spark, path, [1, 7, 12], "1994-03-15", "1997-09-02")
    return rounded(back.select("symbol", "date", "close", "MA5", "MA10", "Volatility20", "Return_1d"), FEAT_ROUND)


@register("fea9_latest_price", f"""WITH {BARS_LI}
SELECT symbol, arg_max(close, date) AS last_price, max(date) AS last_date
FROM bars_li GROUP BY symbol""", dates=("last_date",))
def fea9(spark, sf_dir):
    return rounded(FE.latest_price(FX.bars_li(spark, sf_dir)))


@register("sig1_rule_signal", f"""WITH {BARS_LI}, {features_sql('bars_li')}, {rule_signal_sql('feat')}
SELECT symbol, date, close, signal FROM sig""", bench=True)
def sig1(spark, sf_dir):
    out = SG.rule_signal(FX.bars_li(spark, sf_dir).select("symbol", "date", "close"))
    return rounded(out)


@register("sig2_next_bar_target", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, Return_1d,
       CAST(coalesce(lead(Return_1d) OVER (PARTITION BY symbol ORDER BY date) > 0, false) AS INTEGER) AS Target
FROM feat""")
def sig2(spark, sf_dir):
    f = _feat_li(spark, sf_dir).select("symbol", "date", "Return_1d")
    return rounded(SG.next_bar_target(f))


@register("sig3_pipeline_target", f"""WITH {BARS_LI}, {features_sql('bars_li')},
clean AS (SELECT * FROM feat WHERE close IS NOT NULL AND MA5 IS NOT NULL AND MA10 IS NOT NULL
          AND Volatility20 IS NOT NULL AND Return_1d IS NOT NULL)
SELECT symbol, date, close,
       CAST(coalesce(lead(close) OVER w / NULLIF(close, 0) - 1 > 0, false) AS INTEGER) AS Target
FROM clean WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def sig3(spark, sf_dir):
    out = SG.pipeline_target(_feat_li(spark, sf_dir)).select("symbol", "date", "close", "Target")
    return rounded(out)


# Deterministic up-probability used wherever a SQL-checkable score is needed: the share of
# up moves among the previous 60 returns (the ML training window), NULL before 60 exist.
PROB_N = 60


def prob_up(features: DataFrame) -> DataFrame:
    w = FE.last_n(FE.symbol_window(), PROB_N)
    up = F.sum(F.when(F.col("Return_1d") > 0, 1).otherwise(0)).over(w)
    n = F.count("Return_1d").over(w)
    return features.withColumn("prob_up", F.when(n >= PROB_N, up / F.lit(float(PROB_N))))


PROB_SQL = f"""prob AS (
  SELECT *, CASE WHEN count(Return_1d) OVER w >= {PROB_N}
                 THEN sum(CASE WHEN Return_1d > 0 THEN 1 ELSE 0 END) OVER w / {float(PROB_N)} END AS prob_up
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {PROB_N - 1} PRECEDING AND CURRENT ROW))"""


@register("sig6_probability_signal", f"""WITH {BARS_LI}, {features_sql('bars_li')}, {PROB_SQL}
SELECT symbol, date, {R}(prob_up, 6) AS prob_up,
       CASE WHEN prob_up IS NULL THEN NULL
            WHEN abs(prob_up) > 0 AND abs(prob_up) <= 0.1 THEN NULL
            WHEN prob_up > 0 THEN 'BUY' ELSE 'SELL' END AS signal
FROM prob""")
def sig6(spark, sf_dir):
    f = prob_up(_feat_li(spark, sf_dir))
    out = SG.probability_signal(f).select("symbol", "date", "prob_up", "signal")
    return rounded(out, {"prob_up": 6})


# ---- event log filters (FLT*) ---------------------------------------------------------

@register("flt1_drop_empty_events", """SELECT event_id, event_type, CAST(ts AS DATE) AS day, value
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL""", dates=("day",))
def flt1(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(EV.drop_empty(ev, "event_type", "ts").select(
        "event_id", "event_type", F.to_date("ts").alias("day"), "value"))


@register("flt2_event_log_routing", f"""WITH {BARS_LI},
log AS (SELECT 'MARKET' AS event_type, symbol, date FROM bars_li
        UNION ALL SELECT 'FILL', l_suppkey, l_shipdate FROM li)
SELECT event_type, symbol, count(*) AS n_events FROM log
WHERE event_type = 'FILL' GROUP BY event_type, symbol""", dates=())
def flt2(spark, sf_dir):
    bars = FX.bars_li(spark, sf_dir).select("symbol", "date", "close")
    fills = FX.fills_li(spark, sf_dir).select("symbol", "date", "price", "quantity")
    log = EV.event_log({"MARKET": bars, "FILL": fills})
    routed = EV.route(log, "FILL")
    return routed.groupBy("event_type", "symbol").agg(F.count(F.lit(1)).alias("n_events"))


@register("flt4_zero_to_null", f"""WITH {BARS_EV}
SELECT symbol, date, NULLIF(close, 0) AS close,
       NULLIF(close, 0) / NULLIF(lag(NULLIF(close, 0)) OVER w, 0) - 1 AS ret
FROM bars_ev WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def flt4(spark, sf_dir):
    bars = EV.zero_to_null(FX.bars_ev(spark, sf_dir), "close")
    return rounded(bars.select("symbol", "date", "close",
                               FE.return_1d("close").alias("ret")))


@register("flt5_dropna_series", f"""WITH {BARS_LI}, {features_sql('bars_li')}
SELECT symbol, date, {R}(Volatility20, 8) AS Volatility20 FROM feat WHERE Volatility20 IS NOT NULL""")
def flt5(spark, sf_dir):
    f = _feat_li(spark, sf_dir).select("symbol", "date", "Volatility20")
    return rounded(EV.dropna_series(f, "Volatility20"), {"Volatility20": 8})


@register("flt6_feature_type_guard", f"""WITH {BARS_LI}, {rule_signal_sql('bars_li')}
SELECT symbol, date, signal FROM sig WHERE signal IS NOT NULL""")
def flt6(spark, sf_dir):
    bars = FX.bars_li(spark, sf_dir).select("symbol", "date", "close")
    log = EV.event_log({"FEATURE": bars, "MARKET": bars.select("symbol", "date")})
    return rounded(EV.signals_from_log(log).select("symbol", "date", "signal"))
