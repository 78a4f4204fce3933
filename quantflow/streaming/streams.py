"""Structured Streaming forms of the live operators (STR*).

Sources are file streams (Parquet) with explicit schemas; sinks are Parquet tables or
``foreachBatch`` jobs, with checkpoints in the cluster's shared folder. The stateful operators
are ``StatefulProcessor`` classes: they take rows in any order, keep what may still change
(the fills that the watermark has not passed, or the last bars) next to one small state per
key, and send what comes too late to a marked reject row instead of dropping it unseen. State
grows with the number of keys and the allowed lateness, not with the data volume.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, insort
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quantflow import params as P
from quantflow.session import checkpoint_dir
from quantflow.sources.commits import current_version, publish, read_published

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shuffle files of a write go when it ends, not when the driver happens to collect garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def stream_dir(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{tag}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """STR1: a Parquet file stream with an explicit schema (new files = new bars)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]):
    """Session settings for the length of a job; the session's own return afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rocksdb_state(spark: SparkSession):
    """Stateful processors need the RocksDB state store (state lives on local disk with
    changelogs in the checkpoint, not in executor memory). A batch's shuffle files and the states
    before the last two batches, which no restart reads, do not stay on disk."""
    return settings(spark, {STATE_STORE: ROCKSDB, **DROP_SHUFFLES, "spark.sql.streaming.minBatchesToRetain": "2"})


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that a finished stream leaves and nobody reads: its input, its checkpoint."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(hadoop.Path, paths):
        path.getFileSystem(conf).delete(path, True)


def run_to_table(df: DataFrame, out_path: str, ckpt: str, mode: str = "append",
                 partition_by: str | None = None) -> None:
    """Run a stream over everything available now into a Parquet sink and wait."""
    w = df.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    with rocksdb_state(df.sparkSession):
        w.trigger(availableNow=True).start(out_path).awaitTermination()


def run_foreach_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], ckpt: str,
                      mode: str = "append") -> None:
    with rocksdb_state(df.sparkSession):
        (df.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start()).awaitTermination()


def wall_clock_utc(c):
    """A TIMESTAMP_NTZ wall-clock as the UTC instant with the same fields.

    Event-time windows are aligned to the epoch, so day windows over this instant are the
    calendar days of the wall clock whatever the session time zone."""
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def tick_to_daily_bar(ticks: DataFrame, key: str = "symbol", ts: str = "ts",
                      value: str = "value", watermark: str = "1 day") -> DataFrame:
    """STR2: tumbling one-day OHLCV per key; only windows the watermark has closed are
    emitted (append mode). The watermark needs TIMESTAMP event time: an NTZ column is
    mapped to the UTC instant of its wall clock, and the output date is the window's epoch
    day, so neither depends on the session time zone."""
    c = F.col(ts)
    if isinstance(ticks.schema[ts].dataType, T.TimestampNTZType):
        c = wall_clock_utc(c)
    t = ticks.withColumn("__ev", c)
    return (t.withWatermark("__ev", watermark)
            .groupBy(F.window("__ev", "1 day").alias("w"), F.col(key))
            .agg(F.min_by(value, "__ev").alias("open"), F.max(value).alias("high"),
                 F.min(value).alias("low"), F.max_by(value, "__ev").alias("close"),
                 F.count(F.lit(1)).alias("volume"))
            .select(key, F.date_from_unix_date(
                        F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int")).alias("date"),
                    "open", "high", "low", "close", "volume"))


# ---- per-symbol rolling state: features (STR3) and rule signal (STR5) ----------------

FEATURE_OUT = T.StructType([
    T.StructField("symbol", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("close", T.DoubleType()), T.StructField("MA5", T.DoubleType()),
    T.StructField("MA10", T.DoubleType()), T.StructField("Volatility20", T.DoubleType()),
    T.StructField("Return_1d", T.DoubleType()), T.StructField("signal", T.StringType()),
    T.StructField("revision", T.LongType()), T.StructField("late", T.BooleanType()),
])
BARS_STATE = T.StructType([
    T.StructField("dates", T.ArrayType(T.DateType())), T.StructField("closes", T.ArrayType(T.DoubleType())),
    T.StructField("trimmed", T.LongType()), T.StructField("revision", T.LongType()),
])


def _seq_mean(xs):
    s = 0.0
    for x in xs:
        s += x
    return s / len(xs)


class BarHistory:
    """The last ``need + horizon`` bars of one symbol by date, and the feature rows they give.

    A bar may come late or be revised as long as ``need`` kept bars stand before it (or the
    symbol's history was never cut); then its own row and those of all later kept bars are
    made again. Earlier ones are refused."""

    def __init__(self, lookbacks: Mapping[str, int], window: int, horizon: int,
                 dates=(), closes=(), trimmed: int = 0):
        self.lookbacks, self.window = lookbacks, window
        self.need = max([n for k, n in lookbacks.items() if "MA" in k]
                        + [n + 1 for k, n in lookbacks.items() if "MA" not in k] + [window, 2])
        self.keep = self.need + horizon
        self.dates, self.trimmed = list(dates), trimmed
        self.close = dict(zip(self.dates, closes))
        self.changed = None

    def add(self, date, close) -> bool:
        """Take a bar in; false if it is too late for its rows to be right."""
        at = bisect_left(self.dates, date)
        if self.trimmed and at < self.need:
            return False
        if date not in self.close:
            insort(self.dates, date)
        self.close[date] = close
        self.changed = date if self.changed is None else min(self.changed, date)
        return True

    def rows(self) -> list[dict]:
        """The rows that the bars added since the last call change."""
        if self.changed is None:
            return []
        first = bisect_left(self.dates, self.changed)
        base = max(0, first - self.need)
        closes = [self.close[d] for d in self.dates[base:]]
        rets = [None] + [(c / p - 1) if p is not None and p != 0 and c is not None else None
                         for p, c in zip(closes, closes[1:])]
        out = [self._row(i - base, self.dates[i], closes, rets, self.trimmed + i + 1) for i in range(first, len(self.dates))]
        cut = max(0, len(self.dates) - self.keep)
        for d in self.dates[:cut]:
            del self.close[d]
        self.dates, self.trimmed, self.changed = self.dates[cut:], self.trimmed + cut, None
        return out

    def _row(self, i, date, closes, rets, n) -> dict:
        row = {"date": date, "close": closes[i], "Return_1d": rets[i]}
        for name, k in self.lookbacks.items():
            row[name] = None
            if "MA" in name and i + 1 >= k:
                win = closes[i + 1 - k:i + 1]
                row[name] = _seq_mean(win) if None not in win else None
            elif "Volatility" in name and i + 1 >= k:
                win = rets[i + 1 - k:i + 1]
                if None not in win:
                    m = sum(win) / k
                    row[name] = math.sqrt(sum((x - m) ** 2 for x in win) / (k - 1))
        row["signal"] = None
        if n >= self.window and None not in closes[i + 1 - self.window:i + 1]:
            avg = _seq_mean(closes[i + 1 - self.window:i + 1])
            row["signal"] = "BUY" if closes[i] > avg else ("SELL" if closes[i] < avg else "HOLDING")
        return row


class FeatureProcessor(StatefulProcessor):
    """STR3 / STR5: keeps a ``BarHistory`` per symbol; each call gives correction rows under the
    next revision number, and refused bars as rows marked ``late``."""

    def __init__(self, lookbacks: Mapping[str, int], window: int, horizon: int):
        self.lookbacks, self.window, self.horizon = lookbacks, window, horizon

    def init(self, handle) -> None:
        self.state = handle.getValueState("bars", BARS_STATE)

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else ([], [], 0, 0)
        history = BarHistory(self.lookbacks, self.window, self.horizon, *held[:3])
        revision, out = held[3] + 1, []
        for pdf in rows:
            for date, close in zip(pdf["date"].tolist(), pdf["close"].tolist()):
                if not history.add(date, close):
                    out.append({"date": date, "close": close, "late": True})
        out += [row | {"late": False} for row in history.rows()]
        closes = [history.close[d] for d in history.dates]
        self.state.update((history.dates, closes, history.trimmed, revision))
        yield pd.DataFrame([{"symbol": key[0], "revision": revision} | r for r in out], columns=FEATURE_OUT.names)

    def close(self) -> None:
        pass


def streaming_features(bars: DataFrame, lookbacks: Mapping[str, int] | None = None,
                       window: int = P.RULE_WINDOW, horizon: int = 64) -> DataFrame:
    """STR3 + STR5: FEA1-3 and SIG1 per bar, in update mode.

    Bars may come in any order. A revised or late bar among the symbol's last ``horizon``
    bars makes its row and the rows after it again, with a higher ``revision``; an older one
    comes out as a row marked ``late``. ``latest_features`` gives the rows that hold. Two bars
    of a symbol and date in one micro-batch: the last one read holds."""
    lookbacks = dict(P.DEFAULT_LOOKBACKS if lookbacks is None else lookbacks)
    return bars.select("symbol", "date", "close").groupBy("symbol").transformWithStateInPandas(
        FeatureProcessor(lookbacks, window, horizon), FEATURE_OUT, "update", "none")


def latest_features(rows: DataFrame) -> DataFrame:
    """The last revision of each (symbol, date); refused bars are left out."""
    last = F.struct("revision", *[F.col(c) for c in FEATURE_OUT.names[2:-2]])
    best = rows.where(~F.col("late")).groupBy("symbol", "date").agg(F.max_by(last, "revision").alias("r"))
    return best.select("symbol", "date", "r.*")


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` job that writes each micro-batch into a folder of its own, so that one
    that is run again replaces its rows instead of doubling them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


# ---- per-(account, symbol) ledger state (STR6) ---------------------------------------

LEDGER_OUT = T.StructType([
    T.StructField("symbol", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("date", T.DateType()), T.StructField("direction", T.StringType()),
    T.StructField("quantity", T.DoubleType()), T.StructField("price", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()), T.StructField("commission", T.DoubleType()),
    T.StructField("stamp_tax", T.DoubleType()), T.StructField("realized_pnl", T.DoubleType()),
    T.StructField("trade_pnl", T.DoubleType()), T.StructField("stamp_tax_amount", T.DoubleType()),
    T.StructField("cash_delta", T.DoubleType()), T.StructField("position_qty", T.DoubleType()),
    T.StructField("avg_price", T.DoubleType()), T.StructField("reject_reason", T.StringType()),
])
POSITIONS = ["symbol", "no_symbol", "q", "avg", "bc", "bq", "pnl", "seq"]
PACKED = T.StructType([T.StructField("rows", T.BinaryType())])
DAY_MS = 86_400_000
#: Direction of a row that carries no fill, only the clock: it lets the watermark pass the last day.
CLOCK = "CLOCK"


def pack(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one state value (Arrow IPC): the state interface takes values one by one."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def unpack(value: tuple[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(value[0]).read_pandas()


def pack_arrays(columns: Mapping[str, np.ndarray]) -> tuple[bytes]:
    """``pack`` for columns without nulls, at a fraction of the cost."""
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def unpack_arrays(value: tuple[bytes]) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(value[0]).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}


class LedgerProcessor(StatefulProcessor):
    """STR6: fills wait in a list per key until the watermark passes their date; then an
    event-time timer folds them in trade order. A key is a bucket of symbols, each with its own
    position. It has one timer that counts, for the earliest fill that waits (``wake``), however
    many dates wait behind it. A fill of a date that is already folded is given out at once with
    reason ``late`` and does not touch the position."""

    def __init__(self, order: Sequence[str], fees: P.FeeSchedule):
        self.order, self.fees = list(order), fees

    def init(self, handle) -> None:
        self.handle = handle
        self.positions = handle.getValueState("positions", PACKED)
        self.waiting = handle.getListState("waiting", PACKED)
        self.wake = handle.getValueState("wake", T.StructType([T.StructField("ms", T.LongType())]))

    def _wake_at(self, ms: int) -> None:
        if not self.wake.exists() or ms < self.wake.get()[0]:
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    @staticmethod
    def _made(rows: list[dict] | list[tuple], columns: Sequence[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(columns)).reindex(columns=LEDGER_OUT.names)
        # whole numbers stay whole where one is missing
        return out.assign(**{c: pd.array(out[c].astype(object).where(out[c].notna(), None), dtype="Int64") for c in ("symbol", "seq")})

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        late = []
        for pdf in rows:
            pdf = pdf[pdf["direction"] != CLOCK].drop(columns="bucket")
            old = pdf["event_ms"] <= passed
            for r in pdf[old][["symbol", "no_symbol", "date", "direction", "quantity", "price"]].itertuples(index=False):
                late.append((None if r[1] else r[0], *r[2:], False, "late"))
            fresh = pdf[~old]
            if len(fresh):
                self.waiting.appendValue(pack(fresh))
                self._wake_at(int(fresh["event_ms"].min()))
        if late:
            yield self._made(late, ["symbol", "date", "direction", "quantity", "price", "accepted", "reject_reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from quantflow.operators.ledger import apply_fill, new_position
        passed = timerValues.getCurrentWatermarkInMs()
        if not self.wake.exists() or self.wake.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())  # an earlier fill has woken the key since
        rows = pd.concat([unpack(v) for v in self.waiting.get()], ignore_index=True)
        due, rest = rows[rows["event_ms"] <= passed], rows[rows["event_ms"] > passed]
        due = due.sort_values(["no_symbol", "symbol", *self.order], kind="stable", na_position="first")
        held = {}
        if self.positions.exists():
            held = {r[:2]: [list(r[2:7]), r[7]] for r in unpack(self.positions.get()).itertuples(index=False, name=None)}
        out = []
        columns = [due[c].tolist() for c in ("symbol", "no_symbol", "date", "direction")]
        columns += [due[c].astype("float64").tolist() for c in ("quantity", "price")]
        for symbol, no_symbol, date, direction, n, p in zip(*columns):
            state = held.setdefault((symbol, no_symbol), [new_position(), 0])
            pos = state[0]
            state[1] += 1
            acc, reason, fee, rate, tax, pnl, cash = apply_fill(pos, direction, n, p, self.fees)
            out.append((None if no_symbol else symbol, state[1], date, direction, n, p, acc, fee, rate, pos[4],
                        pnl, tax, cash, pos[0], pos[1], reason))
        self.positions.update(pack(pd.DataFrame([(*k, *pos, seq) for k, (pos, seq) in held.items()], columns=POSITIONS)))
        self.wake.clear()
        if len(rest):
            self.waiting.put([pack(rest)])
            self._wake_at(int(rest["event_ms"].min()))
        else:
            self.waiting.clear()
        return iter([self._made(out, LEDGER_OUT.names)])

    def close(self) -> None:
        pass


def streaming_ledger(fills: DataFrame, order_cols=("date", "l_orderkey", "l_linenumber",
                                                    "l_partkey", "l_extendedprice", "quantity",
                                                    "l_returnflag", "l_linestatus"),
                     fees: P.FeeSchedule = P.FeeSchedule(), delay: str = "30 days",
                     buckets: int = 1024) -> DataFrame:
    """STR6: the LED3/4/6 recurrence with the position as per-symbol streaming state.

    Symbols are dealt into ``buckets`` (more than there are tasks): a bucket's waiting fills and
    positions are read and written at once, as calls of the state store cost far more than a fill.

    Fills may arrive out of order by up to ``delay`` of event time: they are folded in trade
    order once the watermark (latest date seen less ``delay``) passes their date, so the
    result is the batch ledger's. Later ones come out as rows with ``reject_reason = 'late'``
    (and no ``seq``); ``trades`` and ``rejects`` split the two outputs. Fills without a date
    cannot be placed and are left out. State: one position a key, and the fills of ``delay``."""
    day = F.col("date").cast("timestamp")
    ms = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS
    keep = list(dict.fromkeys(["date", "direction", "quantity", "price", *order_cols]))
    # the number of the day, not the watermarked column itself: Spark would drop late rows
    # the clock's rows, with their nulls, keep to themselves
    bucket = F.when(F.col("direction") == CLOCK, -1).otherwise(F.pmod(F.xxhash64("symbol"), F.lit(buckets)))
    timed = (fills.where(F.col("date").isNotNull()).withColumn("__ev", day).withWatermark("__ev", delay)
             .select(bucket.cast("int").alias("bucket"), F.coalesce("symbol", F.lit(0)).cast("long").alias("symbol"),
                     F.col("symbol").isNull().alias("no_symbol"), ms.alias("event_ms"), *keep))
    return timed.groupBy("bucket").transformWithStateInPandas(
        LedgerProcessor(order_cols, fees), LEDGER_OUT, "append", "eventTime")


def trades(ledger: DataFrame) -> DataFrame:
    """The accepted fills of the streaming ledger."""
    return ledger.where(F.col("accepted"))


def rejects(ledger: DataFrame) -> DataFrame:
    """What the streaming ledger refused: late fills, sells without holdings, unknown directions."""
    return ledger.where(~F.col("accepted"))


# ---- running snapshots (STR7) --------------------------------------------------------

def running_snapshot(equity: DataFrame, key: str = "series") -> DataFrame:
    """STR7: latest equity, running peak and drawdown per account (complete mode)."""
    return equity.groupBy(key).agg(
        F.max_by("equity", "date").alias("equity"), F.max("date").alias("date"),
        F.max("equity").alias("peak"), F.count(F.lit(1)).alias("n_points"))


MARKED = ["seq", "position_qty", "cash_delta", "close"]
MARKED_TYPES = ["bigint", "double", "double", "double"]
#: Bits of ``nulls``: which of a row's values are null; in pandas the values themselves are 0 then.
NULL_BIT = {c: 1 << k for k, c in enumerate([*MARKED, "symbol"])}
FILL_BITS = NULL_BIT["seq"] | NULL_BIT["position_qty"] | NULL_BIT["cash_delta"]
PAIR = ["symbol", "event_ms"]
MARKED_OUT = T.StructType([T.StructField("symbol", T.LongType()), T.StructField("event_ms", T.LongType()),
                           T.StructField("nulls", T.LongType()), T.StructField("seq", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in MARKED[1:]]])
HELD = ["is_bar", *MARKED_OUT.names]


def equal_keys(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` of all pairs of equal keys."""
    order = np.argsort(right, kind="stable")
    ordered = right[order]
    first = np.searchsorted(ordered, left, "left")
    n = np.searchsorted(ordered, left, "right") - first
    at = np.repeat(np.arange(len(left)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, order[np.repeat(first, n) + within]


class MarkProcessor(StatefulProcessor):
    """STR7: the join of a bucket of symbols. Rows are held, many packed into one value, until the
    watermark passes their day, as until then the other side may send their partner. Both sides
    of a pair have the same day and leave together, so a row that leaves has met all of its
    partners, and one without any comes out alone."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", PACKED)
        self.wake = handle.getValueState("wake", T.StructType([T.StructField("ms", T.LongType())]))

    @staticmethod
    def _keys(rows: dict[str, np.ndarray]) -> np.ndarray:
        """A number for each (symbol, day); a null symbol is not symbol 0."""
        code = pd.factorize(rows["symbol"])[0].astype("int64") * 2 + (rows["nulls"] & NULL_BIT["symbol"] != 0)
        return code << 32 | rows["event_ms"] // DAY_MS + (1 << 31)

    @staticmethod
    def _pairs(rows: dict[str, np.ndarray], fills: np.ndarray, bars: np.ndarray) -> dict[str, np.ndarray]:
        out = {c: rows[c][fills] for c in MARKED_OUT.names}
        out["close"] = rows["close"][bars]
        out["nulls"] = (out["nulls"] & ~NULL_BIT["close"]) | (rows["nulls"][bars] & NULL_BIT["close"])
        return out

    def _all_held(self) -> list[dict[str, np.ndarray]]:
        return [unpack_arrays(v) for v in self.held.get()] if self.held.exists() else []

    @staticmethod
    def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([p[c] for p in parts]) for c in HELD}

    def handleInputRows(self, key, rows, timerValues):
        fresh = self._joined([{c: pdf[c].to_numpy() for c in HELD} for pdf in rows])
        every = self._joined([*self._all_held(), fresh])
        keys, bar = self._keys(every), every["is_bar"]
        new = np.arange(len(bar)) >= len(bar) - len(fresh["is_bar"])
        for fills, bars in ((~bar & new, bar), (~bar & ~new, bar & new)):
            fills, bars = np.flatnonzero(fills), np.flatnonzero(bars)
            f, b = equal_keys(keys[fills], keys[bars])
            if len(f):
                yield pd.DataFrame(self._pairs(every, fills[f], bars[b]))
        self.held.appendValue(pack_arrays(fresh))
        self._wake_at(int(fresh["event_ms"].min()))

    def _wake_at(self, ms: int) -> None:
        if not self.wake.exists() or ms < self.wake.get()[0]:
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        if not self.wake.exists() or self.wake.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())  # an earlier row has woken the key since
        rows = self._joined(self._all_held())
        gone = rows["event_ms"] <= passed
        rest = {c: v[~gone] for c, v in rows.items()}
        keys, bar = self._keys(rows), rows["is_bar"]
        alone = gone & np.where(bar, ~np.isin(keys, keys[gone & ~bar]), ~np.isin(keys, keys[gone & bar]))
        self.wake.clear()
        if len(rest["is_bar"]):
            self.held.put([pack_arrays(rest)])
            self._wake_at(int(rest["event_ms"].min()))
        else:
            self.held.clear()
        return iter([pd.DataFrame({c: rows[c][alone] for c in MARKED_OUT.names})] if alone.any() else ())

    def close(self) -> None:
        pass


def marked_trades(ledger: DataFrame, bars: DataFrame, delay: str = "30 days", buckets: int = 1024) -> DataFrame:
    """Stream-stream join of accepted fills and bars on (symbol, date): every fill and every
    bar comes out, alone if the other side sent nothing for the day before the watermark (the
    latest date that both sides have sent, less ``delay``). Rows that come after it are left out.

    Symbols are dealt into ``buckets`` (more than there are tasks), whose rows are held packed: a
    row costs some bytes of state and no call of the state store. Keep the number while a
    checkpoint lives."""
    def side(df: DataFrame, is_bar: bool) -> DataFrame:
        # the event time goes along, so that Spark leaves late rows out
        timed = df.withColumn("__at", F.col("date").cast("timestamp")).where(F.col("__at").isNotNull()).withWatermark("__at", delay)
        values = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in zip(MARKED, MARKED_TYPES)}
        nulls = sum((F.when(v.isNull(), NULL_BIT[c]).otherwise(0) for c, v in (values | {"symbol": F.col("symbol")}).items()), F.lit(0))
        ms = F.unix_date("date").cast("bigint") * DAY_MS
        return timed.select(
            "__at", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(is_bar).alias("is_bar"),
            F.coalesce("symbol", F.lit(0)).cast("bigint").alias("symbol"), ms.alias("event_ms"), nulls.cast("bigint").alias("nulls"),
            *[F.coalesce(v, F.lit(0)).cast(t).alias(c) for (c, v), t in zip(values.items(), MARKED_TYPES)])

    t = side(trades(ledger).select("symbol", "date", "seq", "position_qty", "cash_delta"), False)
    b = side(bars.select("symbol", "date", "close"), True)
    out = t.union(b).groupBy("bucket").transformWithStateInPandas(MarkProcessor(), MARKED_OUT, "append", "eventTime")

    def value(c: str):
        held = F.coalesce(c, F.lit(float("nan"))) if c in MARKED[1:] else F.col(c)  # pandas takes NaN for null
        return F.when(F.col("nulls").bitwiseAND(F.lit(NULL_BIT[c])) == 0, held).alias(c)

    return out.select(value("symbol"), F.date_from_unix_date((F.col("event_ms") / DAY_MS).cast("int")).alias("date"),
                      *[value(c) for c in MARKED])


PORTFOLIO = ["symbol", "seq", "quantity", "priced", "price", "cash_delta"]


def fold_portfolio(before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """One row per symbol after a batch of ``marked_trades``: last position (by trade number),
    last price (by date) and the exact sum of its cash flows. Sums and maxima only, so the
    order of rows and batches does not matter."""
    from quantflow.operators.ledger import MONEY, money
    rows = batch.select("symbol", "seq", F.col("position_qty").alias("quantity"),
                        F.when(F.col("close").isNotNull(), F.col("date")).alias("priced"), F.col("close").alias("price"),
                        F.coalesce(money("cash_delta"), F.lit(0).cast(MONEY)).alias("cash_delta"))
    if before is not None:
        rows = rows.unionByName(before.select(*PORTFOLIO))
    return rows.groupBy("symbol").agg(
        F.max("seq").alias("seq"), F.max_by("quantity", "seq").alias("quantity"), F.max("priced").alias("priced"),
        F.max_by("price", "priced").alias("price"), F.sum("cash_delta").cast(MONEY).alias("cash_delta")).select(*PORTFOLIO)


def portfolio_publisher(root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` job that folds each batch of ``marked_trades`` into a new published
    version. Versions carry the micro-batch's number: one that runs again after it was published
    (the same rows, by Structured Streaming's contract) is left alone and so not counted twice."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = current_version(spark, root)
        if done is None or done < batch_id:
            publish(spark, root, fold_portfolio(read_published(spark, root), batch), batch_id)
    return fold


def portfolio_view(state: DataFrame, initial_cash: float = P.INITIAL_CASH) -> DataFrame:
    """STR7's rows: each held symbol's quantity, last price and value, with the account's cash
    and equity."""
    from quantflow.operators.ledger import MONEY, money
    rows = state.withColumn("value", F.col("quantity") * F.coalesce("price", F.lit(0.0)))
    cash = F.lit(initial_cash).cast(MONEY) + F.coalesce(F.sum("cash_delta"), F.lit(0).cast(MONEY))
    account = rows.agg(cash.cast("double").alias("cash"),
                       (cash + F.coalesce(F.sum(money("value")), F.lit(0).cast(MONEY))).cast("double").alias("equity"))
    held = rows.where(F.col("seq").isNotNull()).select("symbol", "quantity", "price", "value")
    return held.crossJoin(F.broadcast(account))  # one row
