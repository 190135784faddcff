"""Exact global ranks and running sums without a single-partition window.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one task.  Both helpers
here split the order into contiguous ranges first, compute per-range totals (a table with one
row per range), turn those into range offsets (a window over that small table), and finish
with a window partitioned by range.  Ranges are chosen so that a hot class or score value
cannot concentrate: by hash bits (uniform) for ranks, by approximate quantiles for scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_BITS = 12  # 4096 ranges; at 10^10 rows that is ~2.5 * 10^6 rows per window partition


def hash_rank_within(df: DataFrame, group: str, key: Column, bits: int = HASH_BUCKET_BITS,
                     tiebreak: str | None = None, hash_bits: int = 64) -> DataFrame:
    """Adds ``_h`` (the ordering hash) and ``rank`` (0-based) of each row within ``group`` in
    (hash, tiebreak) order, plus ``group_n`` (rows in the group).  ``key`` is a signed 64-bit
    hash, or a non-negative one of ``hash_bits`` bits; its top ``bits`` bits pick the range."""
    if hash_bits >= 64:
        b = F.shiftright(F.col("_h"), 64 - bits) + F.lit(1 << (bits - 1))
    else:
        b = F.shiftright(F.col("_h"), max(hash_bits - bits, 0))
    h = df.withColumn("_h", key).withColumn("_b", b)  # _b is monotone in _h
    counts = h.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wb = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_b",
                            F.coalesce(F.sum("_nb").over(wb), F.lit(0)).alias("_off"),
                            F.sum("_nb").over(Window.partitionBy(group)).alias("group_n"))
    order = [F.col("_h")] + ([F.col(tiebreak)] if tiebreak else [])
    wr = Window.partitionBy(group, "_b").orderBy(*order)
    return (h.join(offsets, [group, "_b"])
             .withColumn("rank", F.col("_off") + F.row_number().over(wr) - 1)
             .drop("_b", "_off"))


def ordered_prefix_sums(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = True,
                        n_ranges: int = 256, inclusive: bool = True) -> DataFrame:
    """Adds ``cum_<c>`` for each ``c``: the sum over rows before (and, if ``inclusive``, at) this
    row in ``order_col`` order.  ``df`` should have distinct ``order_col`` values (pre-aggregate
    ties first); ranges come from approximate quantiles of ``order_col``."""
    from pyspark.ml.feature import Bucketizer
    probs = [i / n_ranges for i in range(1, n_ranges)]
    # at most n_ranges - 1 numbers reach the driver, whatever the size of df
    row = df.select(F.percentile_approx(F.col(order_col).cast("double"), probs, 10 * n_ranges)).first()
    inner = sorted({float(b) for b in (row[0] or [])})
    inner = [b for b in inner if b == b and abs(b) != float("inf")] or [0.0]  # no rows, or only NaN
    splits = [float("-inf"), *inner, float("inf")]
    # range index by binary search on the JVM; equal values always share a range
    r = (Bucketizer(splits=splits, inputCol="_ov", outputCol="_rb", handleInvalid="keep")
         .transform(df.withColumn("_ov", F.col(order_col).cast("double")))
         .withColumn("_r", F.col("_rb").cast("int")).drop("_ov", "_rb"))
    totals = r.groupBy("_r").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])  # <= n_ranges rows
    ro = F.desc("_r") if descending else F.asc("_r")
    wt = Window.orderBy(ro).rowsBetween(Window.unboundedPreceding, -1)  # over <= n_ranges rows
    offs = totals.select("_r", *[F.coalesce(F.sum(f"_t_{c}").over(wt), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    oc = F.desc(order_col) if descending else F.asc(order_col)
    frame_end = Window.currentRow if inclusive else -1
    wi = Window.partitionBy("_r").orderBy(oc).rowsBetween(Window.unboundedPreceding, frame_end)
    out = r.join(F.broadcast(offs), "_r")
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wi), F.lit(0)))
    return out.drop("_r", *[f"_o_{c}" for c in sum_cols])
