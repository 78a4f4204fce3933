"""Registered queries: back-test, parameter sweep, risk gates, order formation (BKT*, RSK*, ORD*).

Bars are ``bars_li`` with prices divided by 100 (so an order of 10 fits in the cash).
The SQL oracle replays one-symbol accounts (one per parameter set and symbol) with a
DuckDB recursive CTE over each symbol's date rank, using the fold's float operation order.
Multi-symbol accounts run through the same fold and are covered by unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quantflow import params as P
from quantflow.operators import backtest as BT
from quantflow.operators import events as EVT
from quantflow.operators import risk as RK
from quantflow.operators import signals as SG
from quantflow.plans.oracle_views import ctes
from quantflow.plans.registry import register
from quantflow.plans.util import rounded
from quantflow.session import TASK_ROWS, cut_lineage, dealt
from quantflow.sources import fixtures as FX
from quantflow.sources.tables import read_table

SCALE = 100.0
D = "::DOUBLE"
DEFAULT_GRID = [P.BacktestParams()]
SWEEP_GRID = [P.BacktestParams(window=w, stop_loss=s) for w in (3, 5) for s in (0.05, 0.08)]


def _grid_sql(grid) -> str:
    vals = ", ".join(f"({i}, {g.window}, {g.stop_loss!r}{D}, {g.max_drawdown!r}{D})"
                     for i, g in enumerate(grid))
    return f"prm AS (SELECT * FROM (VALUES {vals}) t(param_id, win, stop_loss, max_dd))"


def backtest_sql(grid) -> str:
    wins = sorted({g.window for g in grid})
    maxw = max(wins)
    w = "OVER (PARTITION BY symbol ORDER BY date)"
    lags = ", ".join(f"lag(close, {k}) {w} AS l{k}" for k in range(1, maxw))
    avg_cases = []
    for W in wins:
        total = f"l{W - 1}" if W > 1 else "close"
        for k in range(W - 2, -1, -1):
            total = f"({total} + {'close' if k == 0 else f'l{k}'})"
        avg_cases.append(f"WHEN {W} THEN {total} / {float(W)}")
    avg = f"(CASE p.win {' '.join(avg_cases)} END)"
    c = "s.close"
    EQ = f"(r.cash + r.q * {c})"
    DD = f"((1 - {EQ} / 100000.0{D}) >= s.max_dd)"
    STOP = f"(r.q > 0 AND {c} > 0 AND ({c} - r.avg_price) / r.avg_price <= -s.stop_loss)"
    OK = f"(s.signal IS NOT NULL AND NOT {DD} AND NOT {STOP})"
    BUY = f"({OK} AND s.signal = 'BUY' AND NOT (r.cash < {c} * 10.0{D}))"
    SELL = f"({OK} AND s.signal = 'SELL' AND NOT (r.q < 10.0{D}) AND r.bq <> 0)"
    HOLD = f"({OK} AND s.signal = 'HOLDING')"
    FPB = f"({c} * (1.0{D} + 0.0005{D}))"
    FPS = f"({c} * (1.0{D} - 0.0005{D}))"
    AMTB, AMTS = f"({FPB} * 10.0{D})", f"({FPS} * 10.0{D})"
    FEEB = f"greatest({AMTB} * 0.001{D}, 5.0{D})"
    FEES = f"(greatest({AMTS} * 0.001{D}, 5.0{D}) + {AMTS} * 0.001{D} + {AMTS} * 0.00001{D})"
    TP = f"(({FPS} - r.avg_price) * 10.0{D} - (10.0{D} / r.bq) * r.bc - {FEES})"
    CASH = f"(CASE WHEN {BUY} THEN r.cash - ({AMTB} + {FEEB}) WHEN {SELL} THEN r.cash + ({AMTS} - {FEES}) ELSE r.cash END)"
    Q = f"(CASE WHEN {BUY} THEN r.q + 10.0{D} WHEN {SELL} THEN r.q - 10.0{D} ELSE r.q END)"
    return f"""{ctes("bars_li")},
{_grid_sql(grid)},
b AS (SELECT symbol, date, close / {SCALE}{D} AS close FROM bars_li),
s0 AS (SELECT symbol, date, close, {lags}, row_number() {w} AS k FROM b),
s AS (SELECT p.param_id, s0.symbol, s0.date, s0.close, s0.k, p.stop_loss, p.max_dd,
             CASE WHEN s0.k < p.win THEN NULL WHEN close > {avg} THEN 'BUY'
                  WHEN close < {avg} THEN 'SELL' ELSE 'HOLDING' END AS signal
      FROM s0 CROSS JOIN prm p),
r AS (
  SELECT param_id, symbol, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS date, 0.0{D} AS close,
         CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS BOOLEAN) AS dd_blocked,
         CAST(NULL AS BOOLEAN) AS stop_blocked, CAST(NULL AS VARCHAR) AS order_reject,
         CAST(NULL AS VARCHAR) AS action, CAST(NULL AS DOUBLE) AS fill_price,
         CAST(NULL AS DOUBLE) AS commission, CAST(NULL AS DOUBLE) AS trade_pnl,
         0.0{D} AS equity_before, 100000.0{D} AS cash, 0.0{D} AS q, 0.0{D} AS avg_price,
         0.0{D} AS bc, 0.0{D} AS bq, 0.0{D} AS pnl, 100000.0{D} AS equity
  FROM (SELECT DISTINCT param_id, symbol FROM s) a
  UNION ALL
  SELECT s.param_id, s.symbol, s.k, s.date, {c}, s.signal,
    CASE WHEN s.signal IS NULL THEN NULL ELSE {DD} END,
    CASE WHEN s.signal IS NULL THEN NULL ELSE {STOP} END,
    CASE WHEN s.signal IS NULL THEN NULL WHEN {DD} OR {STOP} THEN 'risk_blocked'
         WHEN s.signal = 'BUY' AND r.cash < {c} * 10.0{D} THEN 'insufficient_cash'
         WHEN s.signal = 'SELL' AND r.q < 10.0{D} THEN 'insufficient_holdings' END,
    CASE WHEN {BUY} THEN 'BUY' WHEN {SELL} THEN 'SELL' WHEN {HOLD} THEN 'HOLDING' END,
    CASE WHEN {BUY} THEN {FPB} WHEN {SELL} THEN {FPS} WHEN {HOLD} THEN {c} END,
    CASE WHEN {BUY} THEN {FEEB} WHEN {SELL} THEN {FEES} END,
    CASE WHEN {BUY} THEN 0.0{D} WHEN {SELL} THEN {TP} END,
    {EQ},
    {CASH},
    {Q},
    CASE WHEN {BUY} THEN (CASE WHEN r.q + 10.0{D} > 0 THEN (r.avg_price * r.q + {AMTB}) / (r.q + 10.0{D}) ELSE 0.0{D} END)
         WHEN {SELL} THEN (CASE WHEN r.q - 10.0{D} = 0 THEN 0.0{D} ELSE r.avg_price END)
         ELSE r.avg_price END,
    CASE WHEN {BUY} THEN r.bc + {FEEB} WHEN {SELL} AND r.bq > 0 THEN r.bc * (1 - 10.0{D} / r.bq) ELSE r.bc END,
    CASE WHEN {BUY} THEN r.bq + 10.0{D} WHEN {SELL} AND r.bq > 0 THEN r.bq - 10.0{D} ELSE r.bq END,
    CASE WHEN {SELL} THEN r.pnl + {TP} ELSE r.pnl END,
    {Q} * {c} + {CASH}
  FROM r JOIN s ON s.param_id = r.param_id AND s.symbol = r.symbol AND s.k = r.k + 1),
dec AS (SELECT CAST(param_id AS VARCHAR) || ':' || CAST(symbol AS VARCHAR) AS account_id, *
        FROM r WHERE k > 0)"""


def _bars(spark, sf_dir):
    return FX.bars_li(spark, sf_dir, price_scale=SCALE).select("symbol", "date", "close")


def run_backtest(spark, sf_dir, grid=DEFAULT_GRID, output="decisions", bars=None):
    bars = _bars(spark, sf_dir) if bars is None else bars
    prm = BT.params_frame(spark, grid)
    members = BT.one_symbol_accounts(bars, range(len(grid)))
    return BT.backtest(bars, members, prm, output=output)


DEC_COLS = ["account_id", "symbol", "date", "signal", "order_reject", "action", "fill_price", "commission", "trade_pnl", "cash",
            "position_qty", "avg_price", "equity", "realized_pnl"]
SQL_DEC = ("account_id, symbol, date, signal, order_reject, action, "
           "fill_price, commission, trade_pnl, cash, q AS position_qty, avg_price, equity, "
           "pnl AS realized_pnl")

BT_SQL = backtest_sql(DEFAULT_GRID)


@register("bkt1_backtest", f"WITH RECURSIVE {BT_SQL}\nSELECT {SQL_DEC} FROM dec", bench=True)
def bkt1(spark, sf_dir):
    return rounded(run_backtest(spark, sf_dir).select(*DEC_COLS))


@register("bkt2_param_sweep", f"""WITH RECURSIVE {backtest_sql(SWEEP_GRID)}
SELECT account_id, CAST(param_id AS BIGINT) AS param_id, arg_max(equity, k) AS final_equity,
       arg_max(cash, k) AS final_cash, arg_max(pnl, k) AS realized_pnl,
       CAST(count(CASE WHEN action IN ('BUY', 'SELL') THEN 1 END) AS BIGINT) AS n_trades
FROM dec GROUP BY account_id, param_id""", dates=(), bench=True)
def bkt2(spark, sf_dir):
    d = run_backtest(spark, sf_dir, SWEEP_GRID, output="final")
    return d.select("account_id", "param_id", "final_equity", "final_cash", "realized_pnl",
                    "n_trades")


@register("bkt3_replay_multiplicity")
def bkt3(spark, sf_dir):
    """Rows-only (compat mode): one account trading every event type of ``bars_ev``, each
    date replayed once per bar; snapshots are then summed per date as the reference does."""
    bars = FX.bars_ev(spark, sf_dir).select("symbol", "date", "close")
    prm = BT.params_frame(spark, DEFAULT_GRID)
    members = bars.select("symbol").distinct().select(
        F.lit("all").alias("account_id"), F.lit(0).cast("long").alias("param_id"), "symbol")
    dec = BT.backtest(bars, members, prm, replay="per_row")
    snaps = BT.snapshots(dec)
    return rounded(snaps.groupBy("account_id", "date").agg(
        F.sum("equity").alias("equity"), F.count(F.lit(1)).alias("n_snapshots")),
        {"equity": 4})


@register("bkt1_backtest_universe")
def bkt1u(spark, sf_dir):
    """Rows-only: one account over the whole universe of ``bars_li``; daily snapshots. Folded in
    blocks of dates, as all of its rows are one sequence."""
    bars = _bars(spark, sf_dir)
    lines = read_table(spark, sf_dir, "lineitem").count()  # there are no more bars
    prm = BT.params_frame(spark, DEFAULT_GRID)
    members = bars.select("symbol").distinct().select(
        F.lit("universe").alias("account_id"), F.lit(0).cast("long").alias("param_id"),
        "symbol")
    days = BT.backtest(dealt(bars, lines, "symbol"), members, prm, output="days", block_rows=TASK_ROWS)
    return rounded(BT.snapshots(days).drop("replay"))


# ---- risk gates and order formation: table operators over stored account states ---------

def _decided(spark, sf_dir):
    """Signals of the rule, joined to the back-test's stored states before their date and
    decided by ``operators.risk``."""
    bars = cut_lineage(_bars(spark, sf_dir))  # derived once: the back-test, signals and prices read them
    account = F.concat(F.lit("0:"), F.col("symbol").cast("string"))
    state = cut_lineage(run_backtest(spark, sf_dir, bars=bars).select("account_id", "symbol", "date", "position_qty", "avg_price", "cash"))
    signals = SG.rule_signal(bars).where(F.col("signal").isNotNull()).withColumn("account_id", account)
    return RK.decide(RK.state_before(signals, state, state, bars))



@register("rsk1_drawdown_gate", f"""WITH RECURSIVE {BT_SQL}
SELECT account_id, date, equity_before, dd_blocked FROM dec WHERE signal IS NOT NULL""")
def rsk1(spark, sf_dir):
    return rounded(_decided(spark, sf_dir).select("account_id", "date", "equity_before", "dd_blocked"))


@register("rsk2_stop_loss_gate", f"""WITH RECURSIVE {BT_SQL}
SELECT account_id, date, signal, stop_blocked FROM dec WHERE signal IS NOT NULL""")
def rsk2(spark, sf_dir):
    return rounded(_decided(spark, sf_dir).select("account_id", "date", "signal", "stop_blocked"))


@register("rsk3_order_clamp", f"""WITH {ctes("orders_li")}
SELECT symbol, date, net_qty,
       CASE WHEN abs(net_qty) > 100 THEN sign(net_qty) * 100.0 ELSE net_qty END AS clamped_qty
FROM (SELECT symbol, date, sum(CASE WHEN direction = 'BUY' THEN quantity ELSE -quantity END) AS net_qty
      FROM orders_li GROUP BY symbol, date)""")
def rsk3(spark, sf_dir):
    o = FX.orders_li(spark, sf_dir)
    net = o.groupBy("symbol", "date").agg(F.sum(F.when(F.col("direction") == "BUY",
                                                        F.col("quantity"))
                                                 .otherwise(-F.col("quantity"))).alias("net_qty"))
    return rounded(net.withColumn("clamped_qty", RK.clamp_quantity("net_qty")))


@register("rsk4_event_gate", f"""WITH {ctes("bars_li", "orders_li")},
log AS (SELECT 'MARKET' AS event_type, symbol, date AS ts FROM bars_li
        UNION ALL SELECT 'ORDER', symbol, date FROM orders_li
        UNION ALL SELECT 'SIGNAL', symbol, CASE WHEN l_returnflag = 'A' THEN NULL ELSE date END FROM orders_li)
SELECT event_type, count(*) AS n FROM log
WHERE event_type IN ('SIGNAL', 'ORDER') AND ts IS NOT NULL GROUP BY event_type""", dates=())
def rsk4(spark, sf_dir):
    bars = FX.bars_li(spark, sf_dir).select("symbol", F.col("date").alias("ts"))
    o = FX.orders_li(spark, sf_dir)
    orders = o.select("symbol", F.col("date").alias("ts"))
    sigs = o.select("symbol", F.when(F.col("ord.l_returnflag") == "A", F.lit(None))
                    .otherwise(F.col("date")).alias("ts"))
    log = EVT.event_log({"MARKET": bars, "ORDER": orders, "SIGNAL": sigs})
    return RK.event_gate(log).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("ord1_signal_to_order", f"""WITH RECURSIVE {BT_SQL}
SELECT account_id, date, signal, order_reject, action FROM dec WHERE signal IS NOT NULL""")
def ord1(spark, sf_dir):
    return rounded(_decided(spark, sf_dir).select("account_id", "date", "signal", "order_reject", "action"))


@register("ord2_risk_pct_quantity", f"""WITH RECURSIVE {BT_SQL}
SELECT account_id, date, CAST(greatest(floor(cash * 0.01{D} / close), 1) AS BIGINT) AS quantity
FROM dec""")
def ord2(spark, sf_dir):
    d = run_backtest(spark, sf_dir)
    return rounded(d.select("account_id", "date",
                            RK.risk_pct_quantity("cash", "close").alias("quantity")))


@register("flt3_nonzero_equity", f"""WITH RECURSIVE {BT_SQL}
SELECT account_id, symbol, date, q * close AS value FROM dec WHERE q * close <> 0""")
def flt3(spark, sf_dir):
    """Symbol-equity points of the back-test with a non-zero holding value."""
    d = run_backtest(spark, sf_dir).select("account_id", "symbol", "date",
                                           F.col("holding_value").alias("value"))
    return rounded(EVT.nonzero(d, "value"))


@register("bkt4_rejects_report_backtest", f"""WITH RECURSIVE {BT_SQL}
SELECT order_reject AS reject_reason, count(*) AS n FROM dec
WHERE order_reject IS NOT NULL GROUP BY 1""", dates=())
def bkt4b(spark, sf_dir):
    """Signals blocked by the risk gates and orders refused in the back-test, by reason."""
    from quantflow.operators import execution as EX
    d = run_backtest(spark, sf_dir).where(F.col("order_reject").isNotNull())
    return EX.rejects_report(d.withColumnRenamed("order_reject", "reject_reason"))
