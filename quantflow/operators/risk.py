"""Risk gates and order formation (RSK*, ORD*): column expressions, and table operators that
join signals to the account state before the date's fills and decide them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflow import params as P
from quantflow.functions.exprs import col


def drawdown_blocked(equity, peak, max_drawdown: float = P.MAX_DRAWDOWN) -> Column:
    """RSK1: 1 - equity / peak >= limit. The reference's peak stays at the initial equity
    (Q2); pass a running-max column for the intended behaviour."""
    return (F.lit(1.0) - F.try_divide(col(equity), col(peak))) >= F.lit(max_drawdown)


def stop_loss_blocked(qty, price, avg_price, stop_loss: float = P.STOP_LOSS,
                      direction=None, block_sells: bool = True) -> Column:
    """RSK2: held qty > 0, price > 0 and (price - avg) / avg <= -stop -> blocked.

    The reference blocks every direction, SELL included (Q3); ``block_sells=False`` blocks
    only BUY."""
    q, p, a = col(qty), col(price), col(avg_price)
    hit = (q > 0) & (p > 0) & (F.try_divide(p - a, a) <= F.lit(-stop_loss))
    hit = F.coalesce(hit, F.lit(False))
    if not block_sells and direction is not None:
        hit = hit & (col(direction) == "BUY")
    return hit


def clamp_quantity(qty, max_size: int = P.MAX_POSITION_SIZE) -> Column:
    """RSK3: |qty| > max -> sign(qty) * max."""
    q = col(qty)
    return F.when(F.abs(q) > max_size, F.signum(q) * F.lit(float(max_size))).otherwise(q)


def event_gate(events: DataFrame, type_col: str = "event_type", ts_col: str = "ts") -> DataFrame:
    """RSK4: empty events and types other than SIGNAL/ORDER never reach the gate's output."""
    return events.where(F.col(type_col).isNotNull() & F.col(ts_col).isNotNull()
                        & F.col(type_col).isin("SIGNAL", "ORDER"))


def order_reject_reason(signal, cash, price, held_qty, order_size: int = P.ORDER_SIZE) -> Column:
    """ORD1: market order of ``order_size``; BUY needs cash >= price * size (fees and
    slippage ignored); SELL needs a held quantity >= size; HOLDING passes (no-op fill)."""
    s, c, p, h = col(signal), col(cash), col(price), F.coalesce(col(held_qty), F.lit(0.0))
    return (F.when(s.isNull(), F.lit("no_signal"))
            .when((s == "BUY") & (c < p * F.lit(float(order_size))), "insufficient_cash")
            .when((s == "SELL") & (h < F.lit(float(order_size))), "insufficient_holdings"))


def risk_pct_quantity(cash, price, risk_pct: float = P.RISK_PCT) -> Column:
    """ORD2: max(floor(cash * pct / price), 1)."""
    return F.greatest(F.floor(F.try_divide(col(cash) * F.lit(risk_pct), col(price))),
                      F.lit(1)).cast("bigint")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], date: str = "date",
          same_date: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its keys before its date (with
    ``same_date``, up to it); NULL where there is none.

    One union and one window per key: no row is joined to more than one other. Columns of
    ``left`` are carried as one struct, so names cannot clash. ``right`` has one row a key and
    date; null keys match each other.
    """
    ks = list(keys)
    a, b = (1, 0) if same_date else (0, 1)
    some = F.struct(*[F.col(v) for v in values])
    rows = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(ks)], F.col(date).alias("at"), F.lit(a).alias("turn"),
                       F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("own"))
    seen = right.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(ks)], F.col(date).alias("at"), F.lit(b).alias("turn"),
                        some.alias("state"))
    w = (Window.partitionBy(*[f"k{i}" for i in range(len(ks))]).orderBy("at", "turn")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = rows.unionByName(seen, allowMissingColumns=True)
    both = both.withColumn("last", F.last("state", ignorenulls=True).over(w)).where(F.col("own").isNotNull())
    return both.select("own.*", *[F.col(f"last.{v}").alias(v) for v in values])


def state_before(signals: DataFrame, positions: DataFrame, cash: DataFrame, prices: DataFrame,
                 account: str = "account_id", symbol: str = "symbol", date: str = "date",
                 initial_cash: float = P.INITIAL_CASH) -> DataFrame:
    """Signals (account, symbol, date, ...) with the account's state before the date's fills:
    ``cash_before``, ``held_qty``, ``held_avg`` of the signal's symbol, and ``equity_before``,
    the cash and all holdings of the account at the date's prices.

    ``positions`` (account, symbol, date, position_qty, avg_price) and ``cash`` (account, date,
    cash) hold the state after each date's fills, ``prices`` (symbol, date, close) the bars.
    Each account and date is valued once, over the symbols the account ever held.
    """
    days = signals.select(account, date).distinct()
    cash = cash.select(account, date, F.col("cash").alias("cash_before"))
    days = as_of(days, cash, [account], ["cash_before"], date)
    days = days.withColumn("cash_before", F.coalesce("cash_before", F.lit(float(initial_cash))))
    held = positions.select(account, symbol).distinct()
    grid = as_of(days.select(account, date).join(held, account), positions, [account, symbol], ["position_qty"], date)
    grid = as_of(grid.where(F.col("position_qty") != 0), prices, [symbol], ["close"], date, same_date=True)
    worth = grid.groupBy(account, date).agg(F.sum(F.col("position_qty") * F.coalesce("close", F.lit(0.0))).alias("worth"))
    days = days.join(worth, [account, date], "left").withColumn(
        "equity_before", F.col("cash_before") + F.coalesce("worth", F.lit(0.0))).drop("worth")
    own = positions.select(account, symbol, date, F.col("position_qty").alias("held_qty"), F.col("avg_price").alias("held_avg"))
    return as_of(signals, own, [account, symbol], ["held_qty", "held_avg"], date).join(days, [account, date])


def decide(signals: DataFrame, signal: str = "signal", price: str = "close", max_drawdown: float = P.MAX_DRAWDOWN,
           stop_loss: float = P.STOP_LOSS, order_size: int = P.ORDER_SIZE, peak=None,
           initial_cash: float = P.INITIAL_CASH) -> DataFrame:
    """RSK1, RSK2 and ORD1 on the rows of ``state_before``: ``dd_blocked``, ``stop_blocked``,
    ``order_reject`` and ``action`` (the signal that becomes an order or a no-op fill, else
    NULL). The peak is the initial equity unless a column is given."""
    peak = F.lit(float(initial_cash)) if peak is None else peak
    known = F.col(signal).isNotNull()
    out = signals.withColumn("dd_blocked", F.when(known, drawdown_blocked("equity_before", peak, max_drawdown)))
    out = out.withColumn("stop_blocked", F.when(known, stop_loss_blocked("held_qty", price, "held_avg", stop_loss)))
    refused = order_reject_reason(signal, "cash_before", price, "held_qty", order_size)
    out = out.withColumn("order_reject", F.when(known, F.when(F.col("dd_blocked") | F.col("stop_blocked"), "risk_blocked")
                                                 .otherwise(refused)))
    return out.withColumn("action", F.when(known & F.col("order_reject").isNull(), F.col(signal)))


def form_orders(decided: DataFrame, order_size: int = P.ORDER_SIZE, date: str = "date") -> DataFrame:
    """ORD1's orders: a market order of ``order_size`` for every BUY or SELL that passed."""
    return decided.where(F.col("action").isin("BUY", "SELL")).select(
        "account_id", "symbol", date, F.lit("MKT").alias("order_type"), F.col("action").alias("direction"),
        F.lit(float(order_size)).alias("quantity"))
