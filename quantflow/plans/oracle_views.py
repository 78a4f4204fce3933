"""DuckDB SQL for the fixture views, used as CTEs by the oracle queries.

Each mirrors ``quantflow.sources.fixtures`` expression for expression (same DECIMAL sums,
same division order) so that doubles agree bit for bit where the math is identical.
"""

_DEFS = {
    'li': """li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate,
         l_extendedprice / NULLIF(l_quantity, 0) AS price
  FROM lineitem)""",
    'bars_li': """bars_li AS (
  SELECT l_suppkey AS symbol, l_shipdate AS date,
         arg_min(price, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
         max(price) AS high, min(price) AS low,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(sum(l_quantity), 0) AS close,
         sum(l_quantity) AS volume
  FROM li GROUP BY 1, 2)""",
    'bars_ev': """bars_ev AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)""",
    'fills_li': """fills_li AS (
  SELECT l_suppkey AS symbol, l_shipdate AS date,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS direction,
         l_quantity AS quantity, price,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
             l_partkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS seq
  FROM li)""",
    'orders_li': """orders_li AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate - INTERVAL 1 DAY AS DATE) AS date,
         CASE WHEN l_linestatus = 'O' THEN 'LIMIT' ELSE 'MKT' END AS order_type,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS direction,
         l_quantity AS quantity, price AS limit_price,
         l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
         l_returnflag, l_linestatus
  FROM li)""",
    'equity_ord': """equity_ord AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS equity
  FROM orders GROUP BY 1, 2)""",
}
_DEFS["daily_li"] = """daily_li AS (
  SELECT lpad(CAST(symbol AS VARCHAR), 7, '0') AS ts_code,
         CAST(strftime(date, '%Y%m%d') AS INTEGER) AS trade_date,
         CAST(round_even(open, 4) AS DECIMAL(18,4)) AS open,
         CAST(round_even(high, 4) AS DECIMAL(18,4)) AS high,
         CAST(round_even(low, 4) AS DECIMAL(18,4)) AS low,
         CAST(round_even(close, 4) AS DECIMAL(18,4)) AS close,
         CAST(round_even(lag(close) OVER w, 4) AS DECIMAL(18,4)) AS pre_close,
         CAST(round_even(close - lag(close) OVER w, 4) AS DECIMAL(18,4)) AS change,
         CAST(round_even((close / NULLIF(lag(close) OVER w, 0) - 1) * 100, 4) AS DECIMAL(18,4)) AS pct_chg,
         CAST(round_even(volume, 4) AS DECIMAL(18,4)) AS vol,
         CAST(round_even(close * volume, 4) AS DECIMAL(18,4)) AS amount
  FROM bars_li WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
_DEPS = {"bars_li": ["li"], "fills_li": ["li"], "orders_li": ["li"], "daily_li": ["li", "bars_li"]}


def ctes(*names: str) -> str:
    """Comma-joined CTE definitions for the named views, dependencies first, each once."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    return ",\n".join(_DEFS[n] for n in order)


def cte_def(name: str) -> str:
    """One view's CTE definition alone (its dependencies assumed already defined)."""
    return _DEFS[name]


LI = ctes("li")
BARS_LI = ctes("bars_li")
BARS_EV = ctes("bars_ev")
FILLS_LI = ctes("fills_li")
ORDERS_LI = ctes("orders_li")
EQUITY_ORD = ctes("equity_ord")


def features_sql(src: str, lookbacks: dict[str, int] | None = None) -> str:
    """FEA1-4 over a bars CTE named ``src``; yields CTE ``feat``."""
    lookbacks = lookbacks or {"MA5": 5, "MA10": 10, "Volatility20": 20}
    cols = []
    for name, n in lookbacks.items():
        frame = (f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING "
                 f"AND CURRENT ROW)")
        if "MA" in name:
            # Spark's sliding-frame avg adds the frame oldest-first from 0.0; mirror that order.
            w = "OVER (PARTITION BY symbol ORDER BY date)"
            total = f"lag(close, {n - 1}) {w}" if n > 1 else "close"
            for k in range(n - 2, -1, -1):
                total = f"({total} + {'close' if k == 0 else f'lag(close, {k}) {w}'})"
            cols.append(f"CASE WHEN count(close) {frame} >= {n} THEN {total} / {float(n)} END AS {name}")
        elif "Volatility" in name:
            cols.append(f"CASE WHEN count(Return_1d) {frame} >= {n} THEN stddev_samp(Return_1d) "
                        f"{frame} END AS {name}")
    sel = ",\n         ".join(cols)
    return f"""r1 AS (
  SELECT symbol, date, close,
         close / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS Return_1d
  FROM {src}),
feat AS (
  SELECT symbol, date, close,
         {sel},
         Return_1d
  FROM r1)"""


def rule_signal_sql(src: str = "feat", window: int = 3) -> str:
    """SIG1 with the same left-to-right lag sum as the Spark side; yields CTE ``sig``."""
    w = "OVER (PARTITION BY symbol ORDER BY date)"
    terms = [f"lag(close, {k}) {w}" for k in range(window - 1, 0, -1)] + ["close"]
    total = terms[0]
    for t in terms[1:]:
        total = f"({total} + {t})"
    return f"""sig0 AS (
  SELECT *, {total} / {float(window)} AS __avg, row_number() {w} AS __n FROM {src}),
sig AS (
  SELECT * EXCLUDE (__avg, __n),
         CASE WHEN __n < {window} THEN NULL
              WHEN close > __avg THEN 'BUY'
              WHEN close < __avg THEN 'SELL'
              ELSE 'HOLDING' END AS signal
  FROM sig0)"""
