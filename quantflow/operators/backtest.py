"""Back-test as a partitioned Spark job (BKT1-3).

Semantics (date-synchronous, matching the reference's breadth-first event drain): for each
account and date, (1) mark every close of the date, (2) take the precomputed signals,
(3) run the risk gates and order formation against the state *before any fill of that
date*, (4) apply the fills in symbol order at the date's close +/- slippage, (5) snapshot.

Plan: signals for every window in the parameter grid come from one window pass over the
bars (partitioned by symbol, in parallel). Bars are joined to account membership, the
rows are hash-partitioned by account and sorted by (account, date, symbol) inside each
partition, and ``mapInPandas`` folds the dates carrying one account's state. Memory is one
date of one account (bounded by its universe) plus one Arrow batch, and in Spark the sort of a
task's rows. A sweep (BKT2) is the same job over many accounts, one per (parameter set,
universe), folded in parallel. An account over a large universe is one sequence, whose rows
would all come to one sort: with ``block_rows`` blocks of dates are folded one after the other,
and each account's state is written between them. Where only the account's days are asked for
(``output="days"``), a date of many symbols is decided on arrays, by the same operations.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence
from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflow import params as P
from quantflow.operators.ledger import apply_fill, new_position
from quantflow.operators.signals import rule_avg
from quantflow.session import checkpoint_dir

IN_COLS = ["account_id", "param_id", "symbol", "date", "replay", "close"]
PARAM_COLS = [f.name for f in fields(P.BacktestParams)]

OUT_FIELDS = [
    ("signal", T.StringType()), ("dd_blocked", T.BooleanType()),
    ("stop_blocked", T.BooleanType()), ("order_reject", T.StringType()),
    ("action", T.StringType()), ("fill_price", T.DoubleType()), ("commission", T.DoubleType()),
    ("trade_pnl", T.DoubleType()), ("realized_pnl", T.DoubleType()),
    ("position_qty", T.DoubleType()), ("avg_price", T.DoubleType()),
    ("equity_before", T.DoubleType()), ("cash", T.DoubleType()), ("equity", T.DoubleType()),
    ("holding_value", T.DoubleType()),
]


def params_frame(spark, grid: Sequence[P.BacktestParams], ids: Sequence | None = None) -> DataFrame:
    """A parameter table (one row per setting) from a list of settings."""
    rows = [(ids[i] if ids else i, *[getattr(g, c) for c in PARAM_COLS])
            for i, g in enumerate(grid)]
    schema = T.StructType([T.StructField("param_id", T.LongType(), False)] + [
        T.StructField(c, {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}[
            type(getattr(P.BacktestParams(), c))], False) for c in PARAM_COLS])
    return spark.createDataFrame(rows, schema)


def with_grid_signals(bars: DataFrame, windows: Sequence[int], key="symbol",
                      order="date", price="close") -> DataFrame:
    """SIG1 for every distinct window of the grid, in one window pass over the bars."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    cols = {}
    for W in sorted(set(windows)):
        avg = rule_avg(price, W, key, order)
        cols[f"__sig{W}"] = (F.when(n < W, F.lit(None).cast("string"))
                             .when(F.col(price) > avg, "BUY").when(F.col(price) < avg, "SELL")
                             .otherwise("HOLDING"))
    return bars.withColumns(cols)


OUT_COLS = IN_COLS + [n for n, _ in OUT_FIELDS]
FINAL_FIELDS = [("account_id", T.StringType()), ("param_id", T.LongType()),
                ("last_date", T.DateType()), ("final_cash", T.DoubleType()),
                ("final_equity", T.DoubleType()), ("realized_pnl", T.DoubleType()),
                ("n_trades", T.LongType())]
FINAL_COLS = [n for n, _ in FINAL_FIELDS]
DAY_COLS = ["account_id", "param_id", "date", "replay", "equity_before", "cash", "equity"]
#: Signals as numbers, for arrays; 0 is none.
SIGNALS = [None, "BUY", "SELL", "HOLDING"]
STATE = ["cash", "pos", "prices", "peak", "equity", "last_date", "n_trades"]


def _fold(grid: dict, fees: P.FeeSchedule = P.FeeSchedule(), final_only: bool = False,
          carry: bool = False):
    """Date fold of one account at a time; a small helper run inside ``mapInPandas``.

    ``grid`` maps param_id -> parameter dict (the sweep grid, captured in the closure, so
    rows carry only the id). Rows arrive sorted by (account, date, replay, symbol). With
    ``final_only`` one row per account (its end state) leaves the Python worker. With ``carry``
    there is a column ``state``: the row that has one comes before an account's others, which go
    on from there, and each account gives such a row after its others.
    """
    out_cols = OUT_COLS + ["state"] * carry

    def run(batches):
        st = {"acct": None}
        out = {c: [] for c in out_cols}
        fin = {c: [] for c in FINAL_COLS}

        def close_account():
            if st["acct"] is None:
                return
            if carry:
                row = dict(zip(IN_COLS, st["last"]), state=pickle.dumps({c: st[c] for c in STATE}))
                for c in out_cols:
                    out[c].append(row.get(c))
                return
            for c, v in zip(FINAL_COLS, (st["acct"], st["pid"], st["last_date"], st["cash"],
                                         st["equity"], sum(p[4] for p in st["pos"].values()),
                                         st["n_trades"])):
                fin[c].append(v)

        def reset(acct, pid):
            if final_only or carry:
                close_account()
            prm = grid[pid]
            st.update(acct=acct, pid=pid, prm=prm, cash=float(prm["initial_cash"]), pos={},
                      prices={}, peak=float(prm["initial_cash"]),
                      size=float(prm["order_size"]), equity=float(prm["initial_cash"]),
                      last_date=None, n_trades=0)

        def step(rows):
            prm, prices, pos, size = st["prm"], st["prices"], st["pos"], st["size"]
            for r in rows:
                prices[r[2]] = r[5]
            equity_pre = st["cash"] + sum(p[0] * prices.get(s, 0.0) for s, p in pos.items())
            if prm["running_peak"]:
                st["peak"] = max(st["peak"], equity_pre)
            peak, slip = st["peak"], prm["slippage"]
            dec = []
            orders = []
            for j, r in enumerate(rows):
                sym, px, sig = r[2], r[5], r[6]
                d = [None, None, None, None, None, None, None]  # dd, stop, reject, action, fp, fee, tpnl
                dec.append(d)
                if sig is None:
                    continue
                dd = peak != 0 and (1 - equity_pre / peak) >= prm["max_drawdown"]
                p = pos.get(sym)
                stop = False
                if p is not None and p[0] > 0 and px > 0 and p[1] != 0:
                    stop = (px - p[1]) / p[1] <= -prm["stop_loss"]
                    if not prm["block_sells_on_stop"] and sig != "BUY":
                        stop = False
                d[0], d[1] = dd, stop
                if dd or stop:
                    d[2] = "risk_blocked"
                elif sig == "BUY" and st["cash"] < px * size:
                    d[2] = "insufficient_cash"
                elif sig == "SELL" and (p is None or p[0] < size):
                    d[2] = "insufficient_holdings"
                else:
                    orders.append(j)
            for j in orders:
                r, d = rows[j], dec[j]
                sym, px, sig = r[2], r[5], r[6]
                sign = 1 if sig == "BUY" else (-1 if sig == "SELL" else 0)
                fp = px * (1 + sign * slip)
                p = pos.setdefault(sym, new_position())  # q, avg, bc, bq, pnl
                d[3], d[4] = sig, fp
                if sig not in ("BUY", "SELL"):
                    continue  # HOLDING fills at the close and changes nothing
                acc, reason, fee, _, _, tpnl, cash = apply_fill(p, sig, size, fp, fees)
                if not acc:
                    d[2], d[3] = reason, None
                    continue
                st["cash"] += cash
                st["n_trades"] += 1
                d[5], d[6] = fee, tpnl
            hold = {s: p[0] * prices.get(s, 0.0) for s, p in pos.items()}
            equity = sum(hold.values()) + st["cash"]
            st["equity"], st["last_date"] = equity, rows[-1][3]
            if final_only:
                return
            for r, d in zip(rows, dec):
                p = pos.get(r[2])
                for c, v in zip(IN_COLS, r):
                    out[c].append(v)
                for c, v in zip(("dd_blocked", "stop_blocked", "order_reject", "action",
                                 "fill_price", "commission", "trade_pnl"), d):
                    out[c].append(v)
                out["signal"].append(r[6])
                out["realized_pnl"].append(p[4] if p else 0.0)
                out["position_qty"].append(p[0] if p else 0.0)
                out["avg_price"].append(p[1] if p else 0.0)
                out["equity_before"].append(equity_pre)
                out["cash"].append(st["cash"])
                out["equity"].append(equity)
                out["holding_value"].append(hold.get(r[2], 0.0))
                if carry:
                    out["state"].append(None)

        def flush():
            cols, buf = (FINAL_COLS, fin) if final_only else (out_cols, out)
            res = pd.DataFrame(buf, columns=cols)
            for c in cols:
                buf[c] = []
            return res

        pending, step_key = [], None
        for pdf in batches:
            if pdf.empty:
                continue
            sig = pdf["signal"].astype(object).where(pdf["signal"].notna(), None)
            cols = [pdf[c].tolist() for c in IN_COLS] + [sig.tolist()]
            states = pdf["state"].tolist() if carry else [None] * len(pdf)
            for r, state in zip(zip(*cols), states):
                key = (r[0], r[3], r[4])
                if key != step_key:
                    if pending:
                        step(pending)
                        pending = []
                    if r[0] != st["acct"]:
                        reset(r[0], r[1])
                    step_key = key
                if carry:
                    st["last"] = r[:6]
                if state is not None:
                    st.update(pickle.loads(state))
                else:
                    pending.append(r)
            if out["account_id"] or fin["account_id"]:
                yield flush()
        if pending:
            step(pending)
        if final_only or carry:
            close_account()
        if out["account_id"] or fin["account_id"]:
            yield flush()

    return run


class _Held:
    """The positions of an account as arrays, in the order in which they were opened: the order
    in which their values are added up."""

    def __init__(self, pos: dict, prices: dict, dtype):
        self.symbols = np.array(list(pos), dtype=dtype)
        self.q, self.avg = (np.array([p[k] for p in pos.values()], dtype="float64") for k in (0, 1))
        self.price = np.array([prices.get(s, 0.0) for s in pos], dtype="float64")
        self.order = np.argsort(self.symbols)
        self.ordered = self.symbols[self.order]

    def rows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row has a position, and which."""
        if not len(self.symbols):
            return np.zeros(len(symbols), dtype=bool), np.zeros(len(symbols), dtype="int64")
        at = np.minimum(np.searchsorted(self.ordered, symbols), len(self.ordered) - 1)
        return self.ordered[at] == symbols, self.order[at]

    def worth(self) -> float:
        return sum((self.q * self.price).tolist())


def _fold_days(grid: dict, fees: P.FeeSchedule = P.FeeSchedule(), carry: bool = False):
    """``_fold`` for the accounts' days: one row per step with the state after it. Signals come
    as places in ``SIGNALS``. The decisions of a date depend on the state before it only, so they
    are made on arrays; what is ordered is filled in turn."""
    cols = DAY_COLS + ["state"] * carry

    def run(batches):
        st = {"acct": None}
        out = []

        def close_account():
            if st["acct"] is not None and carry:
                state = pickle.dumps({c: st[c] for c in STATE})
                out.append((st["acct"], st["pid"], None, 0, None, None, None, state))

        def reset(acct, pid):
            close_account()
            prm = grid[pid]
            cash = float(prm["initial_cash"])
            st.update(acct=acct, pid=pid, prm=prm, cash=cash, pos={}, prices={}, peak=cash, equity=cash, last_date=None, n_trades=0)

        def step(date, replay, syms, px, sig, held):
            """Decide and fill one date; ``held`` mirrors the positions, or is made again."""
            prm, pos, prices, size = st["prm"], st["pos"], st["prices"], float(st["prm"]["order_size"])
            held = held or _Held(pos, prices, syms.dtype)
            has, at = held.rows(syms)
            held.price[at[has]] = px[has]  # of several rows of a symbol the last one holds
            equity_pre = st["cash"] + held.worth()
            if prm["running_peak"]:
                st["peak"] = max(st["peak"], equity_pre)
            peak = st["peak"]
            dd = peak != 0 and (1 - equity_pre / peak) >= prm["max_drawdown"]
            orders = np.empty(0, dtype="int64")
            if not dd:
                q, avg = np.zeros(len(px)), np.zeros(len(px))
                q[has], avg[has] = held.q[at[has]], held.avg[at[has]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    stop = (q > 0) & (px > 0) & (avg != 0) & ((px - avg) / avg <= -prm["stop_loss"])
                    if not prm["block_sells_on_stop"]:
                        stop &= sig == 1
                    poor = (sig == 1) & (st["cash"] < px * size)
                    short = (sig == 2) & (~has | (q < size))
                orders = np.flatnonzero((sig > 0) & ~stop & ~poor & ~short)
            if len(orders):
                prices.update(zip(held.symbols.tolist(), held.price.tolist()))
                names = syms.tolist()
                last = dict(zip(names, px.tolist()))
                for j in orders.tolist():
                    sym, side = names[j], SIGNALS[sig[j]]
                    sign = 1 if side == "BUY" else (-1 if side == "SELL" else 0)
                    prices[sym] = last[sym]
                    p = pos.setdefault(sym, new_position())
                    if sign == 0:
                        continue  # HOLDING fills at the close and changes nothing
                    acc, _, _, _, _, _, cash = apply_fill(p, side, size, float(px[j]) * (1 + sign * prm["slippage"]), fees)
                    if acc:
                        st["cash"] += cash
                        st["n_trades"] += 1
                held = _Held(pos, prices, syms.dtype)
            equity = held.worth() + st["cash"]
            st["equity"], st["last_date"] = equity, date
            out.append((st["acct"], st["pid"], date, replay, equity_pre, st["cash"], equity) + (None,) * carry)
            return held

        def settle(held):
            if held is not None:
                st["prices"].update(zip(held.symbols.tolist(), held.price.tolist()))

        def flush():
            res = pd.DataFrame(out, columns=cols).astype({"date": "Int32"})
            out.clear()
            return res

        held, pending, at = None, [], None

        def finish(held):
            if not pending:
                return held
            syms, px, sig = (np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*pending))
            pending.clear()
            return step(at[1], at[2], syms, px, sig, held)

        for pdf in batches:
            if pdf.empty:
                continue
            acct, pid, state = pdf["account_id"].tolist(), pdf["param_id"].tolist(), pdf["state"].tolist() if carry else None
            day, replay = pdf["date"].to_numpy(), pdf["replay"].to_numpy()
            arrays = pdf["symbol"].to_numpy(), pdf["close"].to_numpy(dtype="float64"), pdf["signal"].to_numpy()
            names = pdf["account_id"].to_numpy()
            new = (names[1:] != names[:-1]) | (replay[1:] != replay[:-1]) | ((day[1:] != day[:-1]) & ~(pd.isna(day[1:]) & pd.isna(day[:-1])))
            if carry:
                marked = pdf["state"].notna().to_numpy()
                new |= marked[1:] | marked[:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(names)]
            for lo, hi in zip(edges, edges[1:]):
                d = None if pd.isna(day[lo]) else int(day[lo])
                mark = carry and state[lo] is not None
                key = (acct[lo], d, int(replay[lo]))
                if key != at or mark:
                    held = finish(held)
                    if acct[lo] != st["acct"]:
                        settle(held)
                        held = None
                        reset(acct[lo], pid[lo])
                    at = None if mark else key
                if mark:
                    st.update(pickle.loads(state[lo]))
                    held = None
                else:
                    pending.append(tuple(a[lo:hi] for a in arrays))
            if out:
                yield flush()
        held = finish(held)
        settle(held)
        close_account()
        if out:
            yield flush()

    return run


def backtest(bars: DataFrame, membership: DataFrame, params: DataFrame,
             num_partitions: int | None = None, replay: str = "per_date",
             output: str = "decisions", block_rows: int | None = None) -> DataFrame:
    """BKT1/BKT2: per (account, symbol, date) decision and state rows.

    ``bars(symbol, date, close)``; ``membership(account_id, param_id, symbol)``;
    ``params(param_id, <BacktestParams fields>)``. The parameter table is the sweep grid, a
    user-supplied list of settings: it is read once on the driver and travels inside the
    fold's closure, so rows carry only ``param_id``. ``replay="per_row"`` (BKT3) replays a
    date once per bar of that date, as the reference iterator does. ``output="final"``
    returns one end-state row per account (what a sweep ranks) instead of every decision, and
    ``output="days"`` one row per account and step (``DAY_COLS``; what ``snapshots`` takes).
    ``block_rows`` folds blocks of whole dates of about as many rows, one after the other, for
    accounts whose rows are too many for one task's sort; not for end states.
    """
    spark = bars.sparkSession
    grid = {r["param_id"]: r.asDict() for r in params.collect()}  # the user's grid, bounded
    windows = sorted({g["window"] for g in grid.values()})
    b = bars.select("symbol", "date", "close")
    if replay == "per_row":
        b = replay_rows(b)
    elif replay == "per_date":
        b = b.withColumn("replay", F.lit(0))
    else:
        raise ValueError("replay must be per_date or per_row")
    sb = with_grid_signals(b, windows, order=["date", "replay"])
    win_of = F.create_map(*[x for pid, g in grid.items() for x in (F.lit(pid), F.lit(g["window"]))])
    rows = membership.join(sb, "symbol").withColumn("__w", win_of[F.col("param_id")])
    sig = None
    for W in windows:
        sig = (F.when(F.col("__w") == W, F.col(f"__sig{W}")) if sig is None
               else sig.when(F.col("__w") == W, F.col(f"__sig{W}")))
    rows = rows.withColumn("signal", sig)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*IN_COLS, "signal")
    if output not in ("decisions", "days", "final"):
        raise ValueError("output must be decisions, days or final")
    if output == "days":
        code = F.array_position(F.array(*map(F.lit, SIGNALS[1:])), F.col("signal"))
        rows = rows.withColumn("signal", F.coalesce(code, F.lit(0)).cast("tinyint"))
    if block_rows is not None:
        if output == "final" or block_rows < 1:
            raise ValueError("block_rows takes a positive number, and gives decisions or days")
        rows, blocks, folder = _date_blocks(rows, block_rows)
        if len(blocks) > 1:
            return _fold_blocks(rows, blocks, folder, grid, num_partitions, output == "days")
    # Dates cross the Python boundary as day numbers (plain integers convert fastest).
    srt = (rows.repartition(n, "account_id")
           .sortWithinPartitions("account_id", "date", "replay", "symbol")
           .withColumn("date", F.unix_date("date")))
    if output == "final":
        fields = [T.StructField(c, T.IntegerType() if c == "last_date" else t, True)
                  for c, t in FINAL_FIELDS]
        return (srt.mapInPandas(_fold(grid, final_only=True), T.StructType(fields))
                .withColumn("last_date", F.date_from_unix_date("last_date")))
    days = output == "days"
    return (srt.mapInPandas((_fold_days if days else _fold)(grid), _out_schema(srt, days))
            .withColumn("date", F.date_from_unix_date("date")))


def _out_schema(rows: DataFrame, days: bool = False) -> T.StructType:
    types = dict(OUT_FIELDS)
    return T.StructType([rows.schema[c] if c in IN_COLS else T.StructField(c, types[c], True)
                         for c in (DAY_COLS if days else OUT_COLS)])


def _date_blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, list, str]:
    """The rows, stored by ranges of dates, and the last date of each block of whole dates with
    about ``block_rows`` rows; rows without a date are of the first block, as they sort first.
    Files are sorted, all at once in as many tasks: a block's sort then only merges runs."""
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/backtest-{uuid.uuid4().hex[:12]}"
    rows.repartitionByRange("date").sortWithinPartitions("account_id", "date", "replay", "symbol").write.parquet(f"{folder}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    days = stored.groupBy("date").count().orderBy("date").collect()  # one row a date of the calendar
    blocks, held = [], 0
    for day, count in days:
        if blocks and (blocks[-1] is None or held + count <= block_rows):
            blocks[-1] = day
        else:
            blocks.append(day)
            held = 0
        held += count
    return stored, blocks, folder


def _fold_blocks(rows: DataFrame, blocks: list, folder: str, grid: dict, num_partitions: int | None, days: bool) -> DataFrame:
    """Decisions, or days, of one block of dates after the other. A task sorts the rows of one
    block; the states that a block ends with stand before the next one's rows, and are written
    with it."""
    spark = rows.sparkSession
    keys = ["account_id"] if num_partitions is None else [num_partitions, "account_id"]
    states, before, schema, paths = None, None, None, []
    for k, last in enumerate(blocks):
        own = F.col("date") <= F.lit(last)
        own = (own | F.col("date").isNull()) if before is None else own & (F.col("date") > F.lit(before))
        block = rows.where(own).withColumn("date", F.unix_date("date")).withColumn("state", F.lit(None).cast("binary"))
        if schema is None:
            schema = _out_schema(block, days).add("state", T.BinaryType())
        if states is not None:
            # of a state's row only the account is read; no nulls, with which numbers would turn into floats
            block = states.select(*[F.col(c) if c in ("account_id", "param_id", "state") else F.lit(0).cast(block.schema[c].dataType).alias(c)
                                    for c in block.columns]).unionByName(block)
        srt = block.repartition(*keys).sortWithinPartitions(
            "account_id", F.col("state").isNull(), "date", "replay", "symbol")
        paths.append(f"{folder}/block-{k}")
        srt.mapInPandas((_fold_days if days else _fold)(grid, carry=True), schema).write.parquet(paths[-1])
        states = spark.read.schema(schema).parquet(paths[-1]).where("state IS NOT NULL")
        before = last
    return (spark.read.schema(schema).parquet(*paths).where("state IS NULL").drop("state")
            .withColumn("date", F.date_from_unix_date("date")))


def replay_rows(bars: DataFrame) -> DataFrame:
    """BKT3: a date with S bars is replayed S times (one step per input row)."""
    s = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return (bars.withColumn("__s", s)
            .withColumn("replay", F.explode(F.sequence(F.lit(1), F.col("__s").cast("int"))))
            .drop("__s"))


def snapshots(decisions: DataFrame) -> DataFrame:
    """Daily snapshot per account: cash and equity after the date's fills (LED10 numbers)."""
    return (decisions.groupBy("account_id", "param_id", "date", "replay")
            .agg(F.first("cash").alias("cash"), F.first("equity").alias("equity")))


def trades(decisions: DataFrame) -> DataFrame:
    """Trade records of the back-test (BUY/SELL fills)."""
    return decisions.where(F.col("action").isin("BUY", "SELL"))


def one_symbol_accounts(bars: DataFrame, param_ids: Sequence[int] = (0,)) -> DataFrame:
    """Membership where each (parameter set, symbol) is its own account."""
    syms = bars.select("symbol").distinct()
    ids = bars.sparkSession.createDataFrame([(int(i),) for i in param_ids], "param_id long")
    return (syms.crossJoin(F.broadcast(ids))  # the grid is a short user list
            .withColumn("account_id",
                        F.concat_ws(":", F.col("param_id").cast("string"),
                                    F.col("symbol").cast("string"))))
