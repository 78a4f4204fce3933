"""Column expressions shared by operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantflow import params as P


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c, decimals: int = P.DECIMALS) -> Column:
    """Half-even rounding of the binary value, ``rint(x * 10^d) / 10^d``.

    This is numpy's (hence pandas') rounding, and DuckDB's ``round_even``; Spark's
    ``round``/``bround`` instead round the shortest decimal string of the double, which
    differs on values such as 2.675.
    """
    scale = float(10 ** decimals)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def round4(c) -> Column:
    return round_even(c, P.DECIMALS)


def safe_div(a, b) -> Column:
    """Division that yields NULL (never inf/NaN, never an ANSI error) on a zero divisor."""
    return F.try_divide(col(a), col(b))


def pct_change(c, prev) -> Column:
    """``c / prev - 1`` (pandas ``pct_change``); NULL on a zero or missing ``prev``."""
    return F.try_divide(col(c), col(prev)) - 1


def buy_fee(amount, fees: P.FeeSchedule = P.FeeSchedule()) -> Column:
    """LED1: max(amount * rate, minimum)."""
    a = col(amount)
    return F.greatest(a * F.lit(fees.commission_rate), F.lit(fees.min_commission))


def sell_fee(amount, fees: P.FeeSchedule = P.FeeSchedule()) -> Column:
    """LED2: commission (with minimum) + stamp duty + transfer fee."""
    a = col(amount)
    return (F.greatest(a * F.lit(fees.commission_rate), F.lit(fees.min_commission))
            + a * F.lit(fees.stamp_rate) + a * F.lit(fees.transfer_rate))


def direction_sign(direction) -> Column:
    d = col(direction)
    return F.when(d == "BUY", F.lit(1)).when(d == "SELL", F.lit(-1)).otherwise(F.lit(0))


def slipped_price(price, direction, slippage: float = P.SLIPPAGE) -> Column:
    """EXE1: price * (1 + d * slippage), d = +1 BUY, -1 SELL, 0 otherwise."""
    return col(price) * (F.lit(1.0) + direction_sign(direction) * F.lit(slippage))


def yyyymmdd_to_date(c) -> Column:
    """NRM3: int or string yyyyMMdd -> date; unparseable text -> NULL."""
    return F.to_date(F.try_to_timestamp(col(c).cast("string"), F.lit("yyyyMMdd")))
