"""Registered queries: fees, position fold, cash, valuation, trade reports (LED*, RPT5/7/9).

The ledger input is ``fills_li`` (one fill per lineitem row, one account, symbol = supplier).
The oracle replays the same recurrence with a DuckDB recursive CTE over the per-symbol
trade sequence, with the same floating-point operation order as the Spark scan.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantflow.operators import ledger as LG
from quantflow.operators import reports as RP
from quantflow.plans.oracle_views import cte_def, ctes
from quantflow.plans.registry import register
from quantflow.plans.util import rounded
from quantflow.session import cut_lineage
from quantflow.sources import fixtures as FX

D = "::DOUBLE"
AMT = "(f.price * f.quantity)"
BUYFEE = f"greatest({AMT} * 0.001{D}, 5.0{D})"
SELLFEE = f"(greatest({AMT} * 0.001{D}, 5.0{D}) + {AMT} * 0.001{D} + {AMT} * 0.00001{D})"
IS_BUY = "(f.direction = 'BUY')"
SELL_OK = "(f.direction = 'SELL' AND r.bq <> 0)"
TPNL = f"((f.price - r.avg_price) * f.quantity - (f.quantity / r.bq) * r.bc - {SELLFEE})"

LEDGER_SQL = f"""{ctes("fills_li")},
r AS (
  SELECT symbol, CAST(0 AS BIGINT) AS seq, CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS direction,
         0.0{D} AS quantity, 0.0{D} AS price, TRUE AS accepted, 0.0{D} AS commission,
         0.0{D} AS stamp_tax, 0.0{D} AS stamp_tax_amount, 0.0{D} AS trade_pnl,
         0.0{D} AS realized_pnl, 0.0{D} AS cash_delta, 0.0{D} AS q, 0.0{D} AS avg_price,
         0.0{D} AS bc, 0.0{D} AS bq
  FROM (SELECT DISTINCT symbol FROM fills_li) s
  UNION ALL
  SELECT f.symbol, f.seq, f.date, f.direction, f.quantity, f.price,
    {IS_BUY} OR {SELL_OK},
    CASE WHEN {IS_BUY} THEN {BUYFEE} WHEN {SELL_OK} THEN {SELLFEE} ELSE 0.0{D} END,
    CASE WHEN {SELL_OK} THEN 0.001{D} ELSE 0.0{D} END,
    CASE WHEN {SELL_OK} THEN {AMT} * 0.001{D} ELSE 0.0{D} END,
    CASE WHEN {SELL_OK} THEN {TPNL} ELSE 0.0{D} END,
    CASE WHEN {SELL_OK} THEN r.realized_pnl + {TPNL} ELSE r.realized_pnl END,
    CASE WHEN {IS_BUY} THEN -({AMT} + {BUYFEE}) WHEN {SELL_OK} THEN {AMT} - {SELLFEE} ELSE 0.0{D} END,
    CASE WHEN {IS_BUY} THEN r.q + f.quantity WHEN {SELL_OK} THEN r.q - f.quantity ELSE r.q END,
    CASE WHEN {IS_BUY} THEN (CASE WHEN r.q + f.quantity > 0
                                  THEN (r.avg_price * r.q + {AMT}) / (r.q + f.quantity) ELSE 0.0{D} END)
         WHEN {SELL_OK} THEN (CASE WHEN r.q - f.quantity = 0 THEN 0.0{D} ELSE r.avg_price END)
         ELSE r.avg_price END,
    CASE WHEN {IS_BUY} THEN r.bc + {BUYFEE}
         WHEN {SELL_OK} AND r.bq > 0 THEN r.bc * (1 - f.quantity / r.bq) ELSE r.bc END,
    CASE WHEN {IS_BUY} THEN r.bq + f.quantity
         WHEN {SELL_OK} AND r.bq > 0 THEN r.bq - f.quantity ELSE r.bq END
  FROM r JOIN fills_li f ON f.symbol = r.symbol AND f.seq = r.seq + 1),
traj AS (SELECT * FROM r WHERE seq > 0)"""

W = "WITH RECURSIVE "


def _traj(spark, sf_dir):
    return LG.ledger_trajectory(FX.fills_li(spark, sf_dir))


TRADE_COLS = ["symbol", "seq", "date", "direction", "quantity", "price", "commission",
              "stamp_tax", "realized_pnl", "trade_pnl", "stamp_tax_amount"]


@register("led1_buy_fee", f"""WITH {ctes("fills_li")}
SELECT symbol, seq, date, price * quantity AS amount,
       greatest(price * quantity * 0.001{D}, 5.0{D}) AS fee
FROM fills_li WHERE direction = 'BUY'""")
def led1(spark, sf_dir):
    f = LG.fee_columns(_seqd(spark, sf_dir)).where(F.col("direction") == "BUY")
    return rounded(f.select("symbol", "seq", "date", "amount", "fee"))


@register("led2_sell_fee", f"""WITH {ctes("fills_li")}
SELECT symbol, seq, date, price * quantity AS amount,
       greatest(price * quantity * 0.001{D}, 5.0{D}) + price * quantity * 0.001{D}
         + price * quantity * 0.00001{D} AS fee
FROM fills_li WHERE direction = 'SELL'""")
def led2(spark, sf_dir):
    f = LG.fee_columns(_seqd(spark, sf_dir)).where(F.col("direction") == "SELL")
    return rounded(f.select("symbol", "seq", "date", "amount", "fee"))


def _seqd(spark, sf_dir):
    """Fills with their per-symbol trade sequence number: expressions and a window, no Python."""
    w = Window.partitionBy("symbol").orderBy("ord")
    return FX.fills_li(spark, sf_dir).withColumn("seq", F.row_number().over(w).cast("bigint"))


@register("led3_position_fold", f"""{W}{LEDGER_SQL}
SELECT symbol, arg_max(q, seq) AS position_qty, arg_max(avg_price, seq) AS avg_price,
       arg_max(bc, seq) AS total_buy_commission, arg_max(bq, seq) AS total_buy_quantity,
       arg_max(realized_pnl, seq) AS realized_pnl, CAST(sum(CAST(accepted AS INTEGER)) AS BIGINT) AS n_trades
FROM traj GROUP BY symbol""", dates=(), bench=True)
def led3(spark, sf_dir):
    return LG.ledger_states(FX.fills_li(spark, sf_dir))


@register("led3_split_fold", f"""{W}{LEDGER_SQL}
SELECT {", ".join(TRADE_COLS)}, accepted, q AS position_qty, avg_price FROM traj""")
def led3_split(spark, sf_dir):
    """Every fill with its state, keys folded in pieces between flat points."""
    t = LG.ledger_trajectory(FX.fills_li(spark, sf_dir), split_rows=100)
    return rounded(t.select(*TRADE_COLS, "accepted", "position_qty", "avg_price"))


@register("led4_realized_pnl", f"""{W}{LEDGER_SQL}
SELECT symbol, seq, date, trade_pnl, realized_pnl FROM traj
WHERE direction = 'SELL' AND accepted""")
def led4(spark, sf_dir):
    t = LG.trade_records(_traj(spark, sf_dir)).where(F.col("direction") == "SELL")
    return rounded(t.select("symbol", "seq", "date", "trade_pnl", "realized_pnl"))


@register("led5_reject_empty_sell", f"""{W}{LEDGER_SQL}
SELECT symbol, seq, date, quantity, price FROM traj WHERE NOT accepted""")
def led5(spark, sf_dir):
    t = _traj(spark, sf_dir).where(~F.col("accepted"))
    return rounded(t.select("symbol", "seq", "date", "quantity", "price"))


CASH_SQL = f"""{LEDGER_SQL},
daily AS (SELECT date, sum(CAST(round_even(cash_delta, 4) AS DECIMAL(38,4))) AS cash_delta
          FROM traj GROUP BY date),
cash AS (SELECT date, CAST(cash_delta AS DOUBLE) AS cash_delta,
                CAST(CAST(100000 AS DECIMAL(38,4)) + sum(cash_delta) OVER (ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cash FROM daily)"""


@register("led6_cash_flow", f"""{W}{CASH_SQL}
SELECT date, round_even(cash_delta, 4) AS cash_delta, round_even(cash, 4) AS cash FROM cash""")
def led6(spark, sf_dir):
    c = LG.cash_by_date(_traj(spark, sf_dir))
    return rounded(c.select("date", "cash_delta", "cash"), {"cash_delta": 4, "cash": 4})


@register("led7_trade_records", f"""{W}{LEDGER_SQL}
SELECT {", ".join(TRADE_COLS)} FROM traj WHERE accepted""")
def led7(spark, sf_dir):
    return rounded(LG.trade_records(_traj(spark, sf_dir)).select(*TRADE_COLS))


HOLD_SQL = f"""{LEDGER_SQL},
{cte_def("bars_li")},
eod AS (SELECT symbol, date, arg_max(q, seq) AS q FROM traj GROUP BY symbol, date),
cal AS (SELECT DISTINCT date FROM bars_li),
first AS (SELECT symbol, min(date) AS d0 FROM eod GROUP BY symbol),
grid AS (SELECT f.symbol, c.date FROM first f JOIN cal c ON c.date >= f.d0),
g2 AS (SELECT g.symbol, g.date, e.q FROM grid g
       LEFT JOIN eod e ON e.symbol = g.symbol AND e.date = g.date),
g3 AS (SELECT symbol, date, last_value(q IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quantity FROM g2),
hold AS (SELECT g3.symbol, g3.date, g3.quantity, b.close AS price
         FROM g3 ASOF LEFT JOIN bars_li b ON b.symbol = g3.symbol AND g3.date >= b.date),
holdings AS (SELECT symbol, date, quantity, price, quantity * coalesce(price, 0.0{D}) AS value FROM hold)"""


def _holdings(spark, sf_dir):
    return LG.holdings_grid(_eod(spark, sf_dir), _closes(spark, sf_dir))


@register("led8_mark_to_market", f"""{W}{HOLD_SQL}
SELECT symbol, date, quantity, price, value FROM holdings""")
def led8(spark, sf_dir):
    return rounded(_holdings(spark, sf_dir))


EQUITY_SQL = f"""{HOLD_SQL},
{CASH_SQL.split(LEDGER_SQL + ",", 1)[1]},
cal_cash AS (SELECT c.date, CAST(CAST(100000 AS DECIMAL(38,4)) + sum(coalesce(d.cash_delta, CAST(0 AS DECIMAL(38,4))))
             OVER (ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cash
             FROM cal c LEFT JOIN daily d ON d.date = c.date),
hv AS (SELECT date, sum(CAST(round_even(value, 4) AS DECIMAL(38,4))) AS hv FROM holdings GROUP BY date),
eq AS (SELECT c.date, c.cash, CAST(CAST(round_even(c.cash, 4) AS DECIMAL(38,4))
                                   + coalesce(hv.hv, CAST(0 AS DECIMAL(38,4))) AS DOUBLE) AS equity
       FROM cal_cash c LEFT JOIN hv ON hv.date = c.date)"""


def _eod(spark, sf_dir):
    """End-of-day positions, written once: several consumers read them."""
    return cut_lineage(LG.ledger_states(FX.fills_li(spark, sf_dir), date="date"))


def _closes(spark, sf_dir):
    """Bars, derived once: prices and calendar are read from the stored rows."""
    return cut_lineage(FX.bars_li(spark, sf_dir).select("symbol", "date", "close"))


def _equity(spark, sf_dir):
    bars, eod = _closes(spark, sf_dir), _eod(spark, sf_dir)
    cal = bars.select("date")
    hold = LG.holdings_value_by_date(eod, bars, cal)
    cash = LG.cash_by_date(eod, calendar=cal)
    return hold, cash


@register("led9_account_equity", f"""{W}{EQUITY_SQL}
SELECT date, round_even(cash, 4) AS cash, round_even(equity, 4) AS equity FROM eq""",
          bench=True)
def led9(spark, sf_dir):
    hold, cash = _equity(spark, sf_dir)
    return rounded(LG.account_equity(hold, cash), {"cash": 4, "equity": 4})


@register("led10_daily_snapshot")
def led10(spark, sf_dir):
    """Rows-only: the holdings map has no engine-neutral text form; LED9 checks the numbers."""
    bars, eod = _closes(spark, sf_dir), _eod(spark, sf_dir)
    hold = LG.holdings_grid(eod, bars)
    cash = LG.cash_by_date(eod, calendar=bars.select("date"))
    return rounded(LG.daily_snapshot(hold, cash), {"cash": 4, "equity": 4, "total_value": 4})


@register("led10_daily_snapshot_rows", f"""{W}{EQUITY_SQL}
SELECT eq.date, round_even(eq.cash, 4) AS cash, round_even(eq.equity, 4) AS equity,
       round_even(eq.equity, 4) AS total_value, h.symbol, round_even(h.value, 4) AS value
FROM eq LEFT JOIN holdings h ON h.date = eq.date""")
def led10_rows(spark, sf_dir):
    """LED10 as keyed rows: one per date and holding instead of a map of the whole universe."""
    bars, eod = _closes(spark, sf_dir), _eod(spark, sf_dir)
    cash = LG.cash_by_date(eod, calendar=bars.select("date"))
    return rounded(LG.snapshot_rows(LG.holdings_grid(eod, bars), cash),
                   {"cash": 4, "equity": 4, "total_value": 4, "value": 4})


@register("led11_symbol_equity_history", f"""{W}{HOLD_SQL}
SELECT symbol, date, value FROM holdings WHERE value <> 0""")
def led11(spark, sf_dir):
    return rounded(LG.symbol_equity_history(_holdings(spark, sf_dir))
                   .select("symbol", "date", "value"))


@register("led12_equity_df", f"""{W}{EQUITY_SQL}
SELECT date, round_even(sum(equity), 4) AS equity, round_even(sum(cash), 4) AS cash
FROM eq GROUP BY date""")
def led12(spark, sf_dir):
    hold, cash = _equity(spark, sf_dir)
    eq = LG.account_equity(hold, cash)
    out = eq.groupBy("date").agg(F.sum("equity").alias("equity"), F.sum("cash").alias("cash"))
    return rounded(out, {"equity": 4, "cash": 4})


@register("led13_symbol_equity_wide")
def led13(spark, sf_dir):
    """Rows-only: one column for each symbol of the data (display form of LED11)."""
    hist = LG.symbol_equity_history(_holdings(spark, sf_dir))
    symbols = sorted((r[0] for r in hist.select("symbol").distinct().collect()), key=str)
    return LG.symbol_equity_wide(hist, symbols, iso_dates=True)


ALIGNED = list(range(1, 11))  # symbols of the aligned view: the caller's list, not the data's
_aligned = ", ".join(f'max(CASE WHEN symbol = {k} THEN value END) AS "{k}"' for k in ALIGNED)


@register("led13_symbol_equity_aligned", f"""{W}{HOLD_SQL}
SELECT date, {_aligned} FROM holdings WHERE value <> 0 GROUP BY date""")
def led13_aligned(spark, sf_dir):
    """LED13 for a given list of symbols; dates come from all symbols, gaps are NULL."""
    hist = LG.symbol_equity_history(_holdings(spark, sf_dir))
    return rounded(LG.symbol_equity_wide(hist, ALIGNED))


@register("led14_valid_fill_filter", f"""WITH {ctes("fills_li")}
SELECT direction, count(*) AS n, round_even(sum(quantity), 4) AS quantity FROM fills_li
WHERE direction IN ('BUY', 'SELL') GROUP BY direction""", dates=())
def led14(spark, sf_dir):
    v = LG.valid_fills(FX.fills_li(spark, sf_dir))
    return rounded(v.groupBy("direction").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("quantity").alias("quantity")),
                   {"quantity": 4})


# ---- trade-based report datasets ----------------------------------------------------

@register("rpt5_price_with_trades", f"""{W}{LEDGER_SQL},
{cte_def("bars_li")}
SELECT b.symbol, b.date, b.close, t.direction, round_even(t.price, 2) AS trade_price,
       t.quantity, round_even(t.realized_pnl, 2) AS realized_pnl
FROM bars_li b LEFT JOIN (SELECT * FROM traj WHERE accepted) t
  ON t.symbol = b.symbol AND t.date = b.date""")
def rpt5(spark, sf_dir):
    trades = LG.trade_records(_traj(spark, sf_dir))
    return rounded(RP.price_with_trades(FX.bars_li(spark, sf_dir), trades))


@register("rpt7_win_loss", f"""{W}{LEDGER_SQL}
SELECT symbol, CASE WHEN realized_pnl > 0 THEN 'Win' ELSE 'Loss' END AS result, count(*) AS n
FROM traj WHERE accepted GROUP BY 1, 2""", dates=())
def rpt7(spark, sf_dir):
    return RP.win_loss(LG.trade_records(_traj(spark, sf_dir)))


@register("rpt9_symbol_contribution", f"""{W}{LEDGER_SQL}
SELECT symbol, round_even(sum(realized_pnl), 4) AS pnl FROM traj WHERE accepted GROUP BY symbol""",
          dates=())
def rpt9(spark, sf_dir):
    return rounded(RP.symbol_contribution(LG.trade_records(_traj(spark, sf_dir))), {"pnl": 4})


@register("rpt7_win_loss_closed_trades", f"""{W}{LEDGER_SQL}
SELECT symbol, CASE WHEN trade_pnl > 0 THEN 'Win' ELSE 'Loss' END AS result, count(*) AS n
FROM traj WHERE accepted AND direction = 'SELL' GROUP BY 1, 2""", dates=())
def rpt7s(spark, sf_dir):
    """RPT7 option: closed (SELL) trades counted by their own PnL."""
    return RP.win_loss(LG.trade_records(_traj(spark, sf_dir)), "trade_pnl", sells_only=True)
