"""Helpers for registered queries: output forms that both engines reproduce exactly.

- Float outputs that the two engines compute with the same IEEE operations in the same
  order (prices, returns) are left as they are; window/aggregate results whose summation
  order differs between engines are rounded half-even.
- Dates leave as ISO ``yyyy-MM-dd`` text so that no client-side date type is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.functions.exprs import round_even
from pyspark.sql import types as T


def rounded(df: DataFrame, spec: dict[str, int] | None = None) -> DataFrame:
    spec = spec or {}
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in spec:
            c = round_even(c, spec[f.name])
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def iso_dates(sql: str, cols=("date",)) -> str:
    """Wrap oracle SQL so the named DATE columns leave as ISO text."""
    if not cols:
        return sql
    rep = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS __q"
