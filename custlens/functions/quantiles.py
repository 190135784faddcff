"""Exact quantiles (numpy semantics) per group, without a single-task value buffer.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation
buffer, which does not survive a global group of 10^9+ rows.  Here, per group g:

1. one pass: ``percentile_approx`` (rank error <= n/accuracy) gives, for each requested
   probability p, a value bracket [lo, hi] that must contain the order statistics needed
   for p (two error bounds of margin on each side);
2. one pass: count the values below each lo, and keep only the values inside each bracket,
   grouped by value (heavy ties collapse to one row).  The brackets are one small row (a map by
   group, bound as a scalar subquery), so no value is shuffled on its group and there is no join;
3. a running count over each bracket (window partitioned by (g, p); each partition has at
   most about 4n/accuracy distinct values) locates ranks floor(h) and ceil(h), h = (n-1)p.
   A needed rank can sit one step outside a bracket (the sketch's ranks are p*n, the
   interpolation's (n-1)p); the nearest values just below and just above each bracket are
   taken in the counting pass for that case.

``method="linear"`` interpolates like numpy's percentile (from the nearer end, as pandas'
``quantile``/``describe``); ``method="midpoint"`` averages the two order statistics (numpy's
median, used by pandas' ``median``).  Everything is lazy; the driver only plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10000


def _combine(v0: Column, v1: Column, frac: Column, method: str) -> Column:
    if method == "midpoint":
        return (v0 + v1) / 2
    diff = v1 - v0
    return F.when(frac >= 0.5, v1 - diff * (F.lit(1.0) - frac)).otherwise(v0 + diff * frac)


def _scalar_map(df: DataFrame, key: str, columns: list[str]) -> Column:
    """A small table (a row per group, or per group and probability) as a map bound to a plan."""
    entries = F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*columns).alias("value")))
    return df.agg(F.map_from_entries(entries).alias("m")).select("m").scalar()


def grouped_quantiles(df: DataFrame, group: str | None, value: str | Column, probs: list[float],
                      names: list[str], method: str = "linear",
                      accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One row per group (column ``group_key``) with one column per probability (``names``)."""
    v = F.col(value) if isinstance(value, str) else value
    g = F.col(group) if group else F.lit(0)
    vals = df.select(g.alias("g"), v.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    k = len(probs)
    eps = 3.0 / accuracy
    lows = [max(p - eps, 0.0) for p in probs]
    highs = [min(p + eps, 1.0) for p in probs]
    stats = vals.groupBy("g").agg(
        F.count("v").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.percentile_approx("v", lows + highs, accuracy).alias("b"),
    ).select(
        "g", "n",
        *[(F.col("vmin") if lows[i] <= 0.0 else F.col("b")[i]).alias(f"lo{i}") for i in range(k)],
        *[(F.col("vmax") if highs[i] >= 1.0 else F.col("b")[k + i]).alias(f"hi{i}") for i in range(k)],
    )
    brackets = _scalar_map(stats, "g", [c for c in stats.columns if c != "g"])
    tagged = vals.withColumn("_s", F.element_at(brackets, F.col("g"))).select("g", "v", "_s.*")
    below = tagged.groupBy("g").agg(
        F.max("n").alias("n"),
        *[F.count_if(F.col("v") < F.col(f"lo{i}")).alias(f"c{i}") for i in range(k)],
        *[F.max(F.when(F.col("v") < F.col(f"lo{i}"), F.col("v"))).alias(f"prev{i}") for i in range(k)],
        *[F.min(F.when(F.col("v") > F.col(f"hi{i}"), F.col("v"))).alias(f"next{i}") for i in range(k)])
    inside = tagged.select(
        "g",
        F.explode(F.array(*[
            F.when((F.col("v") >= F.col(f"lo{i}")) & (F.col("v") <= F.col(f"hi{i}")), F.lit(i))
            for i in range(k)])).alias("p_idx"),
        "v",
    ).where(F.col("p_idx").isNotNull())
    counted = inside.groupBy("g", "p_idx", "v").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("g", "p_idx").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counted.withColumn("cum_end", F.sum("cnt").over(w))
    pos = (below.select("g", F.explode(F.array(*[
                    F.struct(F.lit(i).alias("p_idx"), F.col(f"c{i}").alias("c"),
                             F.col(f"prev{i}").alias("prev"), F.col(f"next{i}").alias("next"),
                             ((F.col("n") - 1).cast("double") * F.lit(float(probs[i]))).alias("h"))
                    for i in range(k)])).alias("s"))
                .select("g", "s.*")
                .withColumn("k0", F.floor("h").cast("long"))
                .withColumn("k1", F.ceil("h").cast("long"))
                .withColumn("frac", F.col("h") - F.floor("h")))
    pos = pos.withColumn("at", F.struct("g", "p_idx"))
    ranks = _scalar_map(pos, "at", ["c", "prev", "next", "k0", "k1", "frac"])
    j = cum.withColumn("_p", F.element_at(ranks, F.struct("g", "p_idx"))).select("g", "p_idx", "v", "cnt", "cum_end", "_p.*")
    start = F.col("c") + F.col("cum_end") - F.col("cnt")
    end = F.col("c") + F.col("cum_end")
    picked = j.groupBy("g", "p_idx").agg(
        F.max(F.when((F.col("k0") >= start) & (F.col("k0") < end), F.col("v"))).alias("v0"),
        F.max(F.when((F.col("k1") >= start) & (F.col("k1") < end), F.col("v"))).alias("v1"),
        F.max("cum_end").alias("inside"),
        *[F.max(c).alias(c) for c in ("frac", "k0", "k1", "c", "prev", "next")],
    )
    v0 = F.coalesce(F.col("v0"), F.when(F.col("k0") == F.col("c") - 1, F.col("prev")))
    v1 = F.coalesce(F.col("v1"), F.when(F.col("k1") == F.col("c") + F.col("inside"), F.col("next")))
    picked = picked.select("g", "p_idx", _combine(v0, v1, F.col("frac"), method).alias("q"))
    return picked.groupBy(F.col("g").alias("group_key")).agg(
        *[F.max(F.when(F.col("p_idx") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])


def exact_quantile_row(df: DataFrame, value: str | Column, probs: list[float], names: list[str],
                       accuracy: int = DEFAULT_ACCURACY, method: str = "linear") -> DataFrame:
    """Whole-table quantiles as one row (no rows when there are no values)."""
    return grouped_quantiles(df, None, value, probs, names, method, accuracy).drop("group_key")


def exact_median_row(df: DataFrame, value: str | Column, name: str = "median") -> DataFrame:
    return exact_quantile_row(df, value, [0.5], [name], method="midpoint")


# ---------------------------------------------------------------- oracle SQL twin

def quantile_sql(src: str, col: str, p: float, method: str = "linear", where: str = "TRUE") -> str:
    """Scalar SQL subquery: rank selection over the non-null values of ``col`` in ``src``."""
    if method == "midpoint":
        comb = "(v0 + v1) / 2"
    else:
        comb = "CASE WHEN frac >= 0.5 THEN v1 - (v1 - v0) * (1.0 - frac) ELSE v0 + (v1 - v0) * frac END"
    return f"""(SELECT {comb} FROM (
  SELECT MAX(v) FILTER (WHERE rk = FLOOR(h)) AS v0, MAX(v) FILTER (WHERE rk = CEIL(h)) AS v1,
         MAX(h - FLOOR(h)) AS frac
  FROM (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS rk, CAST(COUNT(*) OVER () - 1 AS DOUBLE) * {float(p)!r} AS h
        FROM (SELECT CAST({col} AS DOUBLE) AS v FROM {src}
              WHERE ({where}) AND {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))))))"""
