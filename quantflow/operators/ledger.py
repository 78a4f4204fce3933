"""Cash / position ledger (LED*).

The position recurrence (moving average cost, buy-commission pool, realized PnL) is
order-dependent and branches on exact state values (a SELL is dropped when the buy pool
is exactly 0, the cost resets when the quantity returns to exactly 0). It runs as a sorted
scan: rows are hash-partitioned by the ledger key, sorted by (key, trade order) inside each
partition, and ``mapInPandas`` walks the partition's Arrow batches carrying only the
current key's state. Memory is one Arrow batch whatever the size of a key; different keys
run in parallel, and a hot key can be split where its position is flat (``split_rows``):
there quantity, cost and buy pool are all exactly 0 and the recurrence starts anew. Everything
after the scan (cash, end-of-day positions, valuation) is pre-aggregated to one row per
(key, date) before any window.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflow import params as P
from quantflow.functions.exprs import buy_fee, round_even, sell_fee
from quantflow.session import cut_lineage

MONEY = T.DecimalType(38, 4)


def money(c):
    """A cash amount as DECIMAL(38,4): sums of these are exact, so balances do not depend
    on how the rows were partitioned or in which order they were added."""
    return round_even(c, 4).cast(MONEY)

STATE_FIELDS = [
    ("seq", T.LongType()), ("accepted", T.BooleanType()), ("reject_reason", T.StringType()),
    ("commission", T.DoubleType()), ("stamp_tax", T.DoubleType()),
    ("stamp_tax_amount", T.DoubleType()), ("trade_pnl", T.DoubleType()),
    ("realized_pnl", T.DoubleType()), ("cash_delta", T.DoubleType()),
    ("position_qty", T.DoubleType()), ("avg_price", T.DoubleType()),
    ("total_buy_commission", T.DoubleType()), ("total_buy_quantity", T.DoubleType()),
]


def apply_fill(pos: list, direction: str, n: float, p: float,
               fees: P.FeeSchedule = P.FeeSchedule()) -> tuple:
    """One fill against a position ``[q, avg, buy_comm, buy_qty, realized]`` (mutated).

    Returns ``(accepted, reason, commission, stamp_rate, stamp_amount, trade_pnl,
    cash_delta)``. The float operations and their order are the reference's.
    """
    q, avg, bc, bq, pnl = pos
    amt = p * n
    if direction == "BUY":
        fee = max(amt * fees.commission_rate, fees.min_commission)
        new_q = q + n
        pos[1] = ((avg * q + amt) / new_q) if new_q > 0 else 0.0
        pos[0] = new_q
        pos[2] = bc + fee
        pos[3] = bq + n
        return True, None, fee, 0.0, 0.0, 0.0, -(amt + fee)
    if direction == "SELL":
        fee = (max(amt * fees.commission_rate, fees.min_commission)
               + amt * fees.stamp_rate + amt * fees.transfer_rate)
        if bq == 0:
            return False, "sell_without_holdings", 0.0, 0.0, 0.0, 0.0, 0.0
        tpnl = (p - avg) * n - (n / bq) * bc - fee
        pos[4] = pnl + tpnl
        q -= n
        pos[0] = q
        if q == 0:
            pos[1] = 0.0
        if bq > 0:
            pos[2] = bc * (1 - n / bq)
            pos[3] = bq - n
        return True, None, fee, fees.stamp_rate, amt * fees.stamp_rate, tpnl, amt - fee
    return False, "invalid_direction", 0.0, 0.0, 0.0, 0.0, 0.0


def new_position() -> list:
    return [0.0, 0.0, 0.0, 0.0, 0.0]


def _scan(key_cols: list[str], fees: P.FeeSchedule, carry: list[str], emit: str):
    """Sorted-partition walk of the ledger keys; a small helper run inside ``mapInPandas``. It
    gives out every fill with the state after it, or only a key's last state of each date
    (``days``) or of all (``final``), so that no row a caller drops leaves the worker."""

    def states(batches):
        cur, pos, seq, day, units, accepted = None, new_position(), 0, None, 0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = list(zip(*[pdf[k].tolist() for k in key_cols]))
            days = pdf[carry[0]].tolist() if emit == "days" else [None] * len(pdf)
            rows = []
            for k, t, d, n, p in zip(keys, days, pdf["direction"].tolist(), pdf["quantity"].astype("float64").tolist(),
                                     pdf["price"].astype("float64").tolist()):
                if emit != "fills" and (k != cur or t != day):
                    if cur is not None:
                        rows.append((*cur, day, seq, accepted, units, *pos))
                    units, day = 0, t
                if k != cur:
                    cur, pos, seq, accepted = k, new_position(), 0, 0
                seq += 1
                acc, reason, fee, rate, tax, tpnl, cash = apply_fill(pos, d, n, p, fees)
                if emit == "fills":
                    rows.append((seq, acc, reason, fee, rate, tax, tpnl, pos[4], cash, pos[0], pos[1], pos[2], pos[3]))
                else:
                    accepted += acc
                    units += round(cash * 10_000)  # the flow rounded half-even to 4 places, exactly
            yield pdf, rows
        if emit != "fills" and cur is not None:
            yield None, [(*cur, day, seq, accepted, units, *pos)]

    def run(batches):
        for pdf, rows in states(batches):
            if emit != "fills":
                if rows:
                    yield pd.DataFrame(rows, columns=[*key_cols, "__day", "seq", "n_trades", "cash_units", *POSITION])
                continue
            names = [name for name, _ in STATE_FIELDS]
            out = pdf.drop(columns=[c for c in pdf.columns if c in names])
            yield pd.concat([out, pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)
    return run


POSITION = ["position_qty", "avg_price", "total_buy_commission", "total_buy_quantity", "realized_pnl"]


def _sorted_fills(fills: DataFrame, keys, order, carry, num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(fills.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = fills.select(*dict.fromkeys([*keys, *carry, *order, "direction", "quantity", "price"]))
    sorted_ = base.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    return sorted_.select(*keys, *[c for c in carry if c not in keys], "direction",
                          F.col("quantity").cast("double").alias("quantity"),
                          F.col("price").cast("double").alias("price"))


def ledger_trajectory(fills: DataFrame, keys: Sequence[str] = ("symbol",),
                      order: Sequence[str] = ("ord",), fees: P.FeeSchedule = P.FeeSchedule(),
                      num_partitions: int | None = None,
                      carry: Sequence[str] = ("date",), split_rows: int | None = None) -> DataFrame:
    """LED3/4/5/7/14: one output row per input fill with the state after it.

    ``fills`` needs ``keys``, ``order`` (sort columns), ``direction``, ``quantity``,
    ``price`` and the ``carry`` columns. Rejected rows (a SELL against an empty buy pool,
    a direction other than BUY/SELL) are kept with ``accepted = false`` and unchanged state.

    With ``split_rows`` a key is folded in pieces of about that many fills, in parallel, as far
    as it has flat points (``flat_blocks``); ``order`` must then have no ties within a key.
    The rows are the same; worth it for keys of many millions of fills.
    """
    if split_rows:
        return _split_trajectory(fills, list(keys), list(order), fees, num_partitions, list(carry), split_rows)
    proj = _sorted_fills(fills, list(keys), list(order), list(carry), num_partitions)
    schema = T.StructType(list(proj.schema.fields) + [T.StructField(nm, t, True)
                                                      for nm, t in STATE_FIELDS])
    return proj.mapInPandas(_scan(list(keys), fees, list(carry), "fills"), schema)


def flat_blocks(fills: DataFrame, keys: Sequence[str], order: Sequence[str], split_rows: int) -> DataFrame:
    """``fills`` with ``__seq`` (trade number) and ``__block``: runs of a key's fills that begin
    where its position is flat, bundled to about ``split_rows`` fills.

    While no SELL exceeds the buy pool, the pool is the running sum of signed quantities
    reflected at 0 (a SELL at 0 is dropped): the sum less its least value so far. From the first
    oversell on, and where quantities are not whole numbers (sums of which are exact), nothing
    counts as flat. All of it is windows in the JVM over a few columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.col("quantity").cast("double")
    sign = F.when(F.col("direction") == "BUY", q).when(F.col("direction") == "SELL", -q).otherwise(F.lit(0.0))
    out = fills.withColumn("__seq", F.row_number().over(w).cast("bigint")).withColumn("__sum", F.sum(sign).over(upto))
    out = out.withColumn("__pool", F.col("__sum") - F.least(F.lit(0.0), F.min("__sum").over(upto)))
    out = out.withColumn("__before", F.lag("__pool", 1, 0.0).over(w))
    unsure = (((F.col("direction") == "SELL") & (F.col("__before") > 0) & (F.col("__before") < q))
              | ~F.coalesce((q == F.floor(q)) & q.between(0, 1 << 31), F.lit(False)))
    out = out.withColumn("__unsure", F.coalesce(F.max(unsure).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    starts = F.when((F.col("__before") == 0) & ~F.col("__unsure"), F.col("__seq"))
    block = F.floor(F.last(starts, ignorenulls=True).over(upto) / F.lit(split_rows))
    return out.withColumn("__block", block).drop("__sum", "__pool", "__before", "__unsure")


def _split_trajectory(fills, keys, order, fees, num_partitions, carry, split_rows) -> DataFrame:
    own = [c for c in carry if c not in keys]
    blocks = flat_blocks(fills.select(*keys, *own, *order, "direction", "quantity", "price"), keys, order, split_rows)
    proj = _sorted_fills(blocks.drop(*[c for c in order if c not in own + keys]), [*keys, "__block"], ["__seq"],
                         [*own, "__seq"], num_partitions)
    schema = T.StructType(list(proj.schema.fields) + [T.StructField(nm, t, True) for nm, t in STATE_FIELDS])
    out = proj.mapInPandas(_scan([*keys, "__block"], fees, own, "fills"), schema)
    # profits add up over the key in trade order, by the same additions as in one scan
    upto = Window.partitionBy(*keys).orderBy("__seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("realized_pnl", F.sum("trade_pnl").over(upto)).withColumn("seq", F.col("__seq"))
    return out.drop("__block", "__seq")


def ledger_states(fills: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ord",),
                  fees: P.FeeSchedule = P.FeeSchedule(), num_partitions: int | None = None,
                  date: str | None = None) -> DataFrame:
    """The states that ``final_positions`` (without ``date``) or ``positions_eod`` (per ``date``)
    take from the trajectory, straight from the scan: one row per key (and date) leaves it."""
    ks = list(keys)
    proj = _sorted_fills(fills, ks, list(order), [date] if date else [], num_partitions)
    day = proj.schema[date].dataType if date else T.NullType()
    schema = T.StructType([proj.schema[k] for k in ks] + [T.StructField("__day", day if date else T.StringType())]
                          + [T.StructField(c, T.LongType()) for c in ("seq", "n_trades", "cash_units")]
                          + [T.StructField(c, T.DoubleType()) for c in POSITION])
    out = proj.mapInPandas(_scan(ks, fees, [date] if date else [], "days" if date else "final"), schema)
    if date is None:
        return out.select(*ks, *POSITION, "n_trades")
    flow = (F.col("cash_units").cast("decimal(28,0)") * F.lit(Decimal("0.0001")).cast("decimal(5,4)")).cast(MONEY)
    return out.select(*ks, F.col("__day").alias(date), "position_qty", "avg_price", "realized_pnl", flow.alias("cash_delta"))


def trade_records(traj: DataFrame) -> DataFrame:
    """LED7: accepted fills only; ``realized_pnl`` is the cumulative key PnL (Q5)."""
    return traj.where(F.col("accepted"))


def final_positions(traj: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """LED3 final state per key: the state after the last fill (partial aggregate)."""
    st = F.struct(*[F.col(c) for c in ("position_qty", "avg_price", "total_buy_commission",
                                       "total_buy_quantity", "realized_pnl")])
    agg = traj.groupBy(*keys).agg(F.max_by(st, "seq").alias("__s"),
                                  F.sum(F.col("accepted").cast("long")).alias("n_trades"))
    return agg.select(*keys, "__s.*", "n_trades")


def positions_eod(traj: DataFrame, keys: Sequence[str] = ("symbol",),
                  date: str = "date", materialize: bool = True) -> DataFrame:
    """End-of-date state per key and date (one row per key-date, partial aggregate).

    Several consumers read it (first dates, the valuation grid, cash), and the optimizer
    rewrites each branch differently, so without a cut the Python scan would run once per
    branch. With ``materialize`` the result (keys x dates, far smaller than the fills) is
    checkpointed to the shared folder: the scan runs once and the lineage survives
    executor loss.
    """
    st = F.struct("position_qty", "avg_price", "realized_pnl")
    agg = traj.groupBy(*keys, date).agg(F.max_by(st, "seq").alias("__s"),
                                        F.sum(money("cash_delta")).alias("cash_delta"))
    out = agg.select(*keys, date, "__s.*", "cash_delta")
    return cut_lineage(out) if materialize else out


def cash_by_date(traj: DataFrame, account_keys: Sequence[str] = (), date: str = "date",
                 initial_cash: float = P.INITIAL_CASH,
                 calendar: DataFrame | None = None) -> DataFrame:
    """LED6: cash after each date = initial + running sum of accepted cash flows.

    Accepts the trajectory or its per-(key, date) pre-aggregate (``positions_eod``, whose
    flows are already exact DECIMAL). Flows are summed per (account, date) first, so the
    running window sees one row per date however many fills a date has.
    """
    ak = list(account_keys)
    c = F.col("cash_delta")
    amt = c if isinstance(traj.schema["cash_delta"].dataType, T.DecimalType) else money(c)
    daily = traj.groupBy(*ak, date).agg(F.sum(amt).cast(MONEY).alias("cash_delta"))
    if calendar is not None:
        grid = (calendar.select(*ak, date).distinct() if ak
                else calendar.select(date).distinct())
        daily = (grid.join(daily, [*ak, date], "left")
                 .withColumn("cash_delta", F.coalesce("cash_delta", F.lit(0).cast(MONEY))))
    # One row per (account, date) here: without account keys the running sum is a single
    # partition of at most one row per calendar day, bounded whatever the fill volume.
    w = Window.partitionBy(*ak).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    cash = F.lit(initial_cash).cast(MONEY) + F.sum("cash_delta").over(w)
    return daily.select(*ak, date, F.col("cash_delta").cast("double").alias("cash_delta"),
                        cash.cast("double").alias("cash"))


def holdings_grid(eod: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",),
                  date: str = "date", price: str = "close", symbol: str = "symbol",
                  num_partitions: int | None = None) -> DataFrame:
    """LED8: holdings value ``quantity * last known close`` per key and calendar date,
    from the key's first fill on (no close seen yet -> 0).

    The calendar is the distinct bar dates. Only what changes a key's value is shuffled: its
    end-of-day positions and its bars, one window per key carrying both forward. Each of these
    rows then stands for the days up to the key's next one, which ``sequence`` makes where they
    are, so that the keys x dates rows never move; days outside the calendar are left out.
    """
    ks = list(keys)
    n = num_partitions or int(eod.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cal = bars.select(date).distinct()
    last_day = cal.agg(F.max(date).alias("__end"))
    whole = F.lit(True)
    for k in ks:
        whole = whole & F.col(k).isNotNull()
    dated = eod.where(F.col(date).isNotNull())
    none = F.lit(None).cast("double")
    # a key with a null part has days from its first fill on, but no position is known for them
    held = dated.where(whole).select(*ks, date, "position_qty").unionByName(
        dated.where(~whole).groupBy(*ks).agg(F.min(date).alias(date)).withColumn("position_qty", none))
    held = held.withColumn("__px", none).withColumn("__g", F.lit(True))
    px = bars.where(F.col(symbol).isNotNull()).select(symbol, date, F.col(price).alias("__px"))
    if ks != [symbol]:  # prices reach every held key (e.g. each account holding the symbol)
        px = eod.select(*ks).distinct().join(px, symbol)
    px = px.withColumn("position_qty", none).withColumn("__g", F.lit(False))
    by_key = Window.partitionBy(*ks).orderBy(date, "__g")
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    u = held.unionByName(px).repartition(n, *ks).select(
        *ks, date, "__g", F.last("position_qty", ignorenulls=True).over(upto).alias("quantity"),
        F.last("__px", ignorenulls=True).over(upto).alias("price"),
        F.max("__g").over(upto).alias("__held"), F.lead(date).over(by_key).alias("__next"))
    # a position's own day always counts; of other rows on one day only the last
    upto_next = F.least(F.date_sub("__next", 1), F.col("__end"))
    last = F.when(F.col("__g"), F.greatest(F.col(date), upto_next)).otherwise(upto_next)
    days = (u.where(F.col("__held")).crossJoin(F.broadcast(last_day))  # one-row frame: size-safe broadcast
            .select(*ks, "quantity", "price",
                    F.explode(F.when(F.col(date) <= last, F.sequence(F.col(date), last))).alias(date)))
    grid = days.join(F.broadcast(cal), date, "left_semi")  # one row a calendar day, whatever the data
    return grid.select(
        *ks, date, "quantity", "price",
        (F.col("quantity") * F.coalesce(F.col("price"), F.lit(0.0))).alias("value"))


def holdings_value_by_date(eod: DataFrame, bars: DataFrame, calendar: DataFrame,
                           keys: Sequence[str] = ("symbol",), account_keys: Sequence[str] = (),
                           date: str = "date", price: str = "close",
                           symbol: str = "symbol") -> DataFrame:
    """Sum of holdings values per (account, calendar date) without a keys x dates grid.

    A key's value only changes on its own fill or bar dates, so each key contributes its
    value *changes* (exact DECIMAL deltas) at those dates; the per-date sums of deltas are
    then accumulated over the calendar. Work is proportional to change points.
    """
    ks, ak = list(keys), list(account_keys)
    held = eod.select(*ks).distinct()
    q = eod.select(*ks, date, "position_qty")
    p = held.join(bars.select(F.col(symbol), date, F.col(price).alias("__px")), symbol)
    ev = q.join(p, [*ks, date], "full")
    w = Window.partitionBy(*ks).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    ev = (ev.withColumn("__q", F.last("position_qty", ignorenulls=True).over(w))
          .withColumn("__p", F.last("__px", ignorenulls=True).over(w)))
    val = F.coalesce(money(F.col("__q") * F.coalesce(F.col("__p"), F.lit(0.0))),
                     F.lit(0).cast(MONEY))
    ev = ev.withColumn("__v", val)
    ev = ev.withColumn("__dv", F.col("__v") - F.coalesce(
        F.lag("__v").over(Window.partitionBy(*ks).orderBy(date)), F.lit(0).cast(MONEY)))
    daily = ev.groupBy(*ak, date).agg(F.sum("__dv").cast(MONEY).alias("__dv"))
    grid = calendar.select(*ak, date).distinct()
    d = grid.join(daily, [*ak, date], "left").fillna(0, subset=["__dv"])
    # per-(account, date) rows: bounded by the calendar even without account keys
    wc = Window.partitionBy(*ak).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return d.select(*ak, date, F.sum("__dv").over(wc).cast(MONEY).alias("holdings_value"))


def account_equity(holdings: DataFrame, cash: DataFrame, account_keys: Sequence[str] = (),
                   date: str = "date") -> DataFrame:
    """LED9 / LED12: equity = cash + sum of holdings values per (account, date).

    ``holdings`` is either a per-key grid with ``value`` or the per-date
    ``holdings_value`` of ``holdings_value_by_date``."""
    ak = list(account_keys)
    if "holdings_value" in holdings.columns:
        hv = holdings.select(*ak, date, "holdings_value")
    else:
        hv = holdings.groupBy(*ak, date).agg(F.sum(money("value")).alias("holdings_value"))
    j = cash.select(*ak, date, "cash").join(hv, [*ak, date], "left")
    eq = money("cash") + F.coalesce(F.col("holdings_value"), F.lit(0).cast(MONEY))
    return j.select(*ak, date, "cash", eq.cast("double").alias("equity"))


def daily_snapshot(holdings: DataFrame, cash: DataFrame, account_keys: Sequence[str] = (),
                   date: str = "date", symbol: str = "symbol") -> DataFrame:
    """LED10: (date, cash, equity, holdings map, total_value); the map has one entry per
    symbol held, in the order of symbols, so its size is bounded by the universe."""
    ak = list(account_keys)
    hv = holdings.groupBy(*ak, date).agg(
        F.sum(money("value")).alias("__hv"),
        F.map_from_entries(F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(symbol).alias("s"), "value"))),
            lambda e: F.struct(e["s"].cast("string").alias("key"), e["value"].alias("value")))).alias("holdings"))
    j = cash.select(*ak, date, "cash").join(hv, [*ak, date], "left")
    eq = (money("cash") + F.coalesce(F.col("__hv"), F.lit(0).cast(MONEY))).cast("double")
    return j.select(*ak, date, "cash", eq.alias("equity"), "holdings", eq.alias("total_value"))


def snapshot_rows(holdings: DataFrame, cash: DataFrame, account_keys: Sequence[str] = (),
                  date: str = "date", symbol: str = "symbol") -> DataFrame:
    """LED10 in keyed form: (date, cash, equity, total_value, symbol, value), a row per holding
    and one with a NULL symbol for a date without any. No row grows with the universe."""
    ak = list(account_keys)
    account = account_equity(holdings, cash, ak, date).withColumn("total_value", F.col("equity"))
    columns = [*ak, date, "cash", "equity", "total_value", symbol, "value"]
    # one row a date and account: sent to the holdings, which so stay where they are
    held = holdings.select(*ak, date, symbol, "value").join(F.broadcast(account), [*ak, date]).select(*columns)
    bare = account.join(holdings.select(*ak, date).distinct(), [*ak, date], "left_anti")
    null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in holdings.schema.fields if f.name in (symbol, "value")}
    return held.unionByName(bare.select(*[null.get(c, F.col(c)) for c in columns]))


def symbol_equity_history(holdings: DataFrame) -> DataFrame:
    """LED11: (symbol, date, value) points with value != 0 (FLT3)."""
    return holdings.where(F.col("value") != 0)


#: Up to so many symbols the others' rows are folded into one a date before they are moved.
FEW_SYMBOLS = 1000


def symbol_equity_wide(history: DataFrame, symbols: Sequence, symbol: str = "symbol",
                       date: str = "date", iso_dates: bool = False) -> DataFrame:
    """LED13: aligned view of ``symbols`` (display only; the long form is the primary table).
    ``iso_dates`` writes a row's date out as text where the row is built, not in a step over all
    of its columns.

    A row of the view is as wide as the list. For a long one the points are dealt out and sorted
    by date, and their places in the rows are filled outside the plan, which has no expression
    and no aggregation buffer a symbol (``_wide_rows``). Of a short list only its own points are
    moved, and one row a date for all others."""
    if len(symbols) <= FEW_SYMBOLS:
        own = F.when(F.col(symbol).isin(list(symbols)), F.col(symbol))
        history = history.select(date, own.alias(symbol), "value")
        out = history.groupBy(date).pivot(symbol, list(symbols)).agg(F.first("value"))
        return out.withColumn(date, F.date_format(date, "yyyy-MM-dd")) if iso_dates else out
    points = history.select(date, symbol, F.col("value").cast("double").alias("value")).repartition(date).sortWithinPartitions(date)
    day = history.schema[date]
    schema = T.StructType([T.StructField(date, T.StringType() if iso_dates else day.dataType, day.nullable)] + [T.StructField(str(s), T.DoubleType()) for s in symbols])
    return points.mapInArrow(_wide_rows(list(symbols), iso_dates), schema)


#: Places in the rows of one Arrow batch of a wide view, about (8 bytes each).
WIDE_CELLS = 2_000_000


def _wide_rows(symbols: list, iso_dates: bool = False):
    """Rows of (date, symbol, value), sorted by date, as one row a date with a place for each of
    ``symbols``; of several values of a place the first one read stays. Memory is ``WIDE_CELLS``
    places, or one date's, and an Arrow batch."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        index = pd.Index(symbols)
        names = [None, *map(str, symbols)]
        most = max(1, WIDE_CELLS // len(symbols))
        days, day_type = [], None
        cells = np.zeros((len(symbols), most))
        filled, taken = (np.zeros((len(symbols), most), dtype=bool) for _ in range(2))

        def flush():
            columns = [pa.array([d and d.isoformat() for d in days], type=pa.string()) if iso_dates else pa.array(days, type=day_type)]
            n = len(days)
            bits = np.packbits(filled[:, :n], axis=1, bitorder="little")
            width, values = bits.shape[1], cells[:, :n].copy()  # the batch keeps its own
            bits, values = pa.py_buffer(bits), pa.py_buffer(values)
            columns += [pa.Array.from_buffers(pa.float64(), n, [bits.slice(k * width, width), values.slice(k * n * 8, n * 8)])
                        for k in range(len(symbols))]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            days.clear()
            cells[:], filled[:], taken[:] = 0, False, False
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            day, names[0], day_type = batch.column(0), batch.schema.names[0], batch.schema.types[0]
            runs = day.dictionary_encode(null_encoding="encode")
            codes = runs.indices.to_numpy(zero_copy_only=False)
            found = runs.dictionary.to_pylist()
            place = index.get_indexer(batch.column(1).to_pandas())
            value, known = batch.column(2).to_numpy(zero_copy_only=False), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            edges = np.searchsorted(codes, np.arange(len(found) + 1))  # sorted: a day's rows are one run
            for d, lo, hi in zip(found, edges, edges[1:]):
                if not days or days[-1] != d:
                    if len(days) == most:
                        yield flush()
                    days.append(d)
                at, k = place[lo:hi], len(days) - 1
                rows = np.flatnonzero((at >= 0) & ~taken[at, k])[::-1]  # written backwards, so that the first one stays
                cells[at[rows], k], filled[at[rows], k], taken[at[rows], k] = value[lo:hi][rows], known[lo:hi][rows], True
        if days:
            yield flush()

    return run


def valid_fills(fills: DataFrame) -> DataFrame:
    """LED14: only BUY / SELL fills reach the ledger."""
    return fills.where(F.col("direction").isin("BUY", "SELL"))


def fee_columns(fills: DataFrame, fees: P.FeeSchedule = P.FeeSchedule()) -> DataFrame:
    """LED1 / LED2 as plain expressions on fill rows."""
    amt = F.col("price") * F.col("quantity")
    return fills.withColumn("amount", amt).withColumn(
        "fee", F.when(F.col("direction") == "BUY", buy_fee(amt, fees))
        .when(F.col("direction") == "SELL", sell_fee(amt, fees)))
