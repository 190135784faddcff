"""Text rendering of values, identical in Spark and in the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_text(c: Column | str) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss', plus '.ffffff' when there are sub-second digits."""
    c = F.col(c) if isinstance(c, str) else c
    frac = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    return F.concat(
        F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(F.lit("")),
    )


def ts_text_sql(e: str) -> str:
    frac = f"(((epoch_us({e}) % 1000000) + 1000000) % 1000000)"
    return (f"(strftime({e}, '%Y-%m-%d %H:%M:%S') || CASE WHEN {frac} <> 0 "
            f"THEN '.' || lpad(CAST({frac} AS VARCHAR), 6, '0') ELSE '' END)")
