"""Exact arithmetic that gives identical bits in Spark and in the DuckDB oracle.

Money is carried as ``decimal(18,2)``; sums are exact and only the final value becomes a
double.  Rounded ratios are computed on integers with round-half-even, so no engine's
floating-point rounding at ties can make two results differ.

Each helper has a Spark ``Column`` form and a ``*_sql`` twin producing DuckDB SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
DAY_MICROS = 86_400_000_000


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def cents(c: Column | str) -> Column:
    """decimal(18,2) money -> exact integer cents."""
    c = F.col(c) if isinstance(c, str) else c
    return (c * 100).cast("long")


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Floor of elapsed days between two timestamps (a time-delta's ``.days``)."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    diff = F.unix_micros(later) - F.unix_micros(earlier)
    r = F.pmod(diff, F.lit(DAY_MICROS))
    return ((diff - r) / F.lit(DAY_MICROS)).cast("long")


def whole_days_sql(later: str, earlier: str) -> str:
    d = f"(epoch_us({later}) - epoch_us({earlier}))"
    return f"CAST(({d} - ((({d} % {DAY_MICROS}) + {DAY_MICROS}) % {DAY_MICROS})) // {DAY_MICROS} AS BIGINT)"


def half_even_ratio(num: str, den: str, scale: int, wide: bool = False) -> Column:
    """round_half_even(num / den, scale) for integer columns ``num`` and ``den`` > 0, as double;
    ``wide`` for numerators that a long cannot hold."""
    m = 10 ** scale
    kind = "DECIMAL(38,0)" if wide else "BIGINT"
    n = f"(CAST({num} AS {kind}) * {m})"
    d = f"CAST({den} AS {kind})"
    r = f"pmod({n}, {d})"
    q = f"(({n} - {r}) div {d})"
    return F.expr(
        f"CAST({q} + CASE WHEN 2 * {r} > {d} THEN 1 WHEN 2 * {r} = {d} THEN pmod({q}, 2) ELSE 0 END"
        f" AS DOUBLE) / {m}"
    )


def half_even_ratio_sql(num: str, den: str, scale: int) -> str:
    m = 10 ** scale
    n = f"(CAST({num} AS BIGINT) * {m})"
    d = f"CAST({den} AS BIGINT)"
    r = f"((({n} % {d}) + {d}) % {d})"
    q = f"(({n} - {r}) // {d})"
    return (
        f"CAST({q} + CASE WHEN 2 * {r} > {d} THEN 1 WHEN 2 * {r} = {d} THEN ((({q} % 2) + 2) % 2) ELSE 0 END"
        f" AS DOUBLE) / {m}"
    )
