"""Reports over the transaction history and the RFM table.

Each report is one declarative plan: global aggregates are partial + final
``HashAggregate`` (one row per map task crosses the shuffle), group-bys pre-aggregate
map-side, medians/quartiles use the exact bracketed quantile (no single-task buffer), and
pages are ``TakeOrderedAndProject`` (a per-partition top-n, then a merge of n rows per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens import constants as K
from custlens.functions.exact import money
from custlens.functions.quantiles import exact_median_row, grouped_quantiles, quantile_sql
from custlens.functions.text import ts_text, ts_text_sql


# ------------------------------------------------------------------ D9 / D10

def dataset_summary(hist: DataFrame, rfm: DataFrame) -> DataFrame:
    """Customers, transactions, date range, revenue total / mean / median."""
    h = hist.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.min("transaction_date").alias("d0"),
        F.max("transaction_date").alias("d1"),
    )
    r = rfm.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum(money("monetary").cast("decimal(28,2)")).alias("rev"),
    )
    med = exact_median_row(rfm, "monetary", "revenue_median")
    hs = h.select(F.struct("*")).scalar()
    ms = med.select(F.struct("*")).scalar()
    return r.withColumn("_h", hs).withColumn("_m", ms).select(
        F.col("total_customers"),
        F.col("_h.total_transactions").alias("total_transactions"),
        ts_text(F.col("_h.d0")).alias("date_start"),
        ts_text(F.col("_h.d1")).alias("date_end"),
        F.coalesce(F.col("rev"), F.lit(0)).cast("double").alias("revenue_total"),
        F.try_divide(F.col("rev").cast("double"), F.col("total_customers")).alias("revenue_average"),
        F.col("_m.revenue_median").alias("revenue_median"),
    )


def dataset_summary_sql(hist_sql: str, rfm_sql: str) -> str:
    return f"""
WITH h AS ({hist_sql}), r AS ({rfm_sql})
SELECT (SELECT COUNT(*) FROM r) AS total_customers,
       (SELECT COUNT(*) FROM h) AS total_transactions,
       (SELECT {ts_text_sql('MIN(transaction_date)')} FROM h) AS date_start,
       (SELECT {ts_text_sql('MAX(transaction_date)')} FROM h) AS date_end,
       (SELECT CAST(COALESCE(SUM(CAST(monetary AS DECIMAL(18,2))), 0) AS DOUBLE) FROM r) AS revenue_total,
       (SELECT CAST(SUM(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) FROM r) AS revenue_average,
       {quantile_sql('r', 'monetary', 0.5, 'midpoint')} AS revenue_median
"""


STAT_COLUMNS = ["recency", "frequency", "monetary"]


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivot ``columns`` to (metric, v double) so every column is profiled in one grouped pass."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")
    ).select("s.*")


def _profile(df: DataFrame, columns: list[str], scale: int, with_std: bool) -> DataFrame:
    lv = long_values(df, columns)
    aggs = [F.count("v").alias("n"), F.sum(F.col("v").cast(f"decimal(38,{scale})")).alias("s"),
            F.min("v").alias("min"), F.max("v").alias("max")]
    if with_std:
        aggs.append(F.round(F.stddev_samp("v"), 9).alias("std"))
    return lv, lv.groupBy("metric").agg(*aggs).withColumn(
        "mean", F.try_divide(F.col("s").cast("double"), F.col("n")))


def rfm_statistics(rfm: DataFrame, columns: list[str] = STAT_COLUMNS) -> DataFrame:
    """Mean, median, min, max of recency, frequency, monetary (one row per metric).

    One pass for all metrics: unpivot, then a grouped aggregate and a grouped exact median."""
    lv, prof = _profile(rfm, columns, 2, with_std=False)
    med = grouped_quantiles(lv, "metric", "v", [0.5], ["median"], method="midpoint")
    return (prof.join(med.withColumnRenamed("group_key", "metric"), "metric", "left")
                .select("metric", "mean", "median", "min", "max"))


def rfm_statistics_sql(rfm_sql: str, columns: list[str] = STAT_COLUMNS) -> str:
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS metric, CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({c}) AS mean, "
        f"{quantile_sql('r', c, 0.5, 'midpoint')} AS median, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max FROM r"
        for c in columns)
    return f"WITH r AS ({rfm_sql}) {sel}"


# ------------------------------------------------------------------ D13 / D14 / D23

def value_distribution(hist: DataFrame, column: str, out_name: str) -> DataFrame:
    """Rows per value, descending; the null key is excluded (as pandas does)."""
    return (hist.where(F.col(column).isNotNull())
                .groupBy(F.col(column).alias(out_name))
                .agg(F.count(F.lit(1)).alias("n_transactions"))
                .orderBy(F.desc("n_transactions"), F.col(out_name)))


def value_distribution_sql(hist_sql: str, column: str, out_name: str) -> str:
    return (f"SELECT {column} AS {out_name}, COUNT(*) AS n_transactions FROM ({hist_sql}) "
            f"WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY n_transactions DESC, {out_name}")


def distinct_values(hist: DataFrame, rfm_segmented: DataFrame | None = None) -> DataFrame:
    """Distinct categories, payment methods (and segment names when given), as (kind, value)."""
    parts = [
        hist.select(F.lit("product_category").alias("kind"), F.col("product_category").alias("value")),
        hist.select(F.lit("payment_method").alias("kind"), F.col("payment_method").alias("value")),
    ]
    if rfm_segmented is not None:
        parts.append(rfm_segmented.select(F.lit("segment_name").alias("kind"), F.col("segment_name").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull()).distinct()


def distinct_values_sql(hist_sql: str) -> str:
    return (f"WITH h AS ({hist_sql}) "
            f"SELECT DISTINCT kind, value FROM (SELECT 'product_category' AS kind, product_category AS value FROM h "
            f"UNION ALL SELECT 'payment_method', payment_method FROM h) WHERE value IS NOT NULL")


# ------------------------------------------------------------------ D15

def monthly_revenue(hist: DataFrame) -> DataFrame:
    """Per month revenue, transactions (non-null ids) and distinct customers, ascending."""
    month = F.date_format("transaction_date", "yyyy-MM")
    return (hist.where(F.col("transaction_date").isNotNull())
                .groupBy(month.alias("month"))
                .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("revenue"),
                     F.count("transaction_id").alias("transactions"),
                     F.countDistinct("customer_id").alias("customers"))
                .orderBy("month"))


def monthly_revenue_sql(hist_sql: str) -> str:
    return (f"SELECT strftime(transaction_date, '%Y-%m') AS month, "
            f"CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS revenue, "
            f"COUNT(transaction_id) AS transactions, COUNT(DISTINCT customer_id) AS customers "
            f"FROM ({hist_sql}) WHERE transaction_date IS NOT NULL GROUP BY 1 ORDER BY 1")


# ------------------------------------------------------------------ D18

DESCRIBE_PROBS = [0.25, 0.5, 0.75]


def describe_columns(df: DataFrame, columns: list[str], exact_scale: dict[str, int]) -> DataFrame:
    """Count, mean, std (sample), min, 25%, 50%, 75%, max per column, long format.

    Means are exact for columns with at most ``max(exact_scale)`` decimals; the standard
    deviation is Spark's ``stddev_samp`` rounded to 9 decimals.  One grouped pass for all
    columns plus one grouped exact-quantile pass."""
    scale = max(exact_scale.values()) if exact_scale else 6
    lv, prof = _profile(df, columns, scale, with_std=True)
    qs = grouped_quantiles(lv, "metric", "v", DESCRIBE_PROBS, ["q25", "q50", "q75"])
    return (prof.join(qs.withColumnRenamed("group_key", "metric"), "metric", "left")
                .select(F.col("metric").alias("column"), F.col("n").alias("count"), "mean", "std", "min",
                        "q25", "q50", "q75", "max"))


def describe_columns_sql(src_sql: str, columns: list[str], exact_scale: dict[str, int]) -> str:
    sels = []
    for c in columns:
        scale = exact_scale.get(c)
        s = f"SUM(CAST({c} AS DECIMAL(18,{scale})))" if scale is not None else f"SUM({c})"
        sels.append(
            f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, CAST({s} AS DOUBLE) / COUNT({c}) AS mean, "
            f"ROUND(stddev_samp(CAST({c} AS DOUBLE)), 9) AS std, CAST(MIN({c}) AS DOUBLE) AS min, "
            f"{quantile_sql('src', c, 0.25)} AS q25, {quantile_sql('src', c, 0.5)} AS q50, {quantile_sql('src', c, 0.75)} AS q75, "
            f"CAST(MAX({c}) AS DOUBLE) AS max FROM src")
    return f"WITH src AS ({src_sql}) " + " UNION ALL ".join(sels)


# ------------------------------------------------------------------ D21

def histogram(df: DataFrame, columns: list[str], bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max] per column; the maximum falls in the last bin.

    Output (metric, bin 1..bins, bin_start, bin_end, n); empty bins are not listed.
    """
    parts = []
    for c in columns:
        mm = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) \
               .select(F.struct("lo", "hi")).scalar()
        x = F.col(c).cast("double")
        width = F.col("_mm.hi") - F.col("_mm.lo")
        b = F.when(width == 0, F.lit(1)).otherwise(
            F.least(F.floor((x - F.col("_mm.lo")) / width * bins) + 1, F.lit(bins)))
        counted = (df.where(F.col(c).isNotNull()).withColumn("_mm", mm)
                     .groupBy(b.cast("int").alias("bin"), F.col("_mm")).agg(F.count(F.lit(1)).alias("n")))
        parts.append(counted.select(
            F.lit(c).alias("metric"), "bin",
            (F.col("_mm.lo") + width * (F.col("bin") - 1) / bins).alias("bin_start"),
            (F.col("_mm.lo") + width * F.col("bin") / bins).alias("bin_end"),
            "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram_sql(src_sql: str, columns: list[str], bins: int = K.HISTOGRAM_BINS) -> str:
    sels = []
    for c in columns:
        sels.append(f"""
SELECT '{c}' AS metric, bin,
       lo + (hi - lo) * (bin - 1) / {bins} AS bin_start,
       lo + (hi - lo) * bin / {bins} AS bin_end, COUNT(*) AS n
FROM (SELECT CAST(CASE WHEN hi - lo = 0 THEN 1
                  ELSE LEAST(FLOOR((CAST({c} AS DOUBLE) - lo) / (hi - lo) * {bins}) + 1, {bins}) END AS INTEGER) AS bin,
             lo, hi
      FROM src, (SELECT CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi FROM src) m
      WHERE {c} IS NOT NULL)
GROUP BY bin, lo, hi""")
    return f"WITH src AS ({src_sql}) " + " UNION ALL ".join(sels)


# ------------------------------------------------------------------ D22

def max_transaction_number(hist: DataFrame) -> DataFrame:
    """The first run of digits in each id as a number; the global maximum, 0 if none."""
    num = F.expr("try_cast(regexp_extract(transaction_id, '(\\\\d+)', 1) AS BIGINT)")
    return hist.agg(F.coalesce(F.max(num), F.lit(0).cast("long")).alias("max_transaction_number"))


def max_transaction_number_sql(hist_sql: str) -> str:
    return (f"SELECT COALESCE(MAX(TRY_CAST(regexp_extract(transaction_id, '(\\d+)', 1) AS BIGINT)), 0) "
            f"AS max_transaction_number FROM ({hist_sql})")


# ------------------------------------------------------------------ F2 / F3

def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 10000 or offset < 0:
        raise ValueError("limit must be in 1..10000 and offset >= 0")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset+limit-1 in the given total order, plus the total row count.  Of a table without
    a page index (``sources.pages``): meant for its first pages, as offset + limit rows meet in one task."""
    check_page(limit, offset)
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def page_rfm(rfm: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """RFM rows in stored (customer id) order."""
    return page(rfm, [F.col("customer_id")], limit, offset)


def page_transactions(hist: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """newest transactions first (arrival order = time, then id; full tie-break)."""
    return shown_transactions(page(ordered_transactions(hist), newest_first(), limit, offset))


def ordered_transactions(hist: DataFrame) -> DataFrame:
    """What a page shows, and what it is ordered by."""
    return hist.select("transaction_id", "customer_id", "product_category", "payment_method",
                       F.col("transaction_date").alias("_ts"), F.col("total_amount").alias("_amt"))


def newest_first() -> list:
    return [F.desc_nulls_last("_ts"), F.desc_nulls_last("transaction_id"), F.desc_nulls_last("_amt"),
            F.asc_nulls_last("product_category"), F.asc_nulls_last("payment_method")]


def shown_transactions(rows: DataFrame) -> DataFrame:
    return rows.select("transaction_id", "customer_id", ts_text("_ts").alias("transaction_date"), "product_category", "payment_method",
                       F.col("_amt").cast("double").alias("total_amount"), "total")


def page_sql(src_sql: str, order_sql: str, limit: int, offset: int, cols: str = "*") -> str:
    return (f"SELECT {cols}, (SELECT COUNT(*) FROM ({src_sql})) AS total FROM ({src_sql}) "
            f"ORDER BY {order_sql} LIMIT {limit} OFFSET {offset}")


def page_transactions_sql(hist_sql: str, limit: int = 100, offset: int = 0) -> str:
    return f"""
SELECT transaction_id, customer_id, {ts_text_sql('_ts')} AS transaction_date, product_category, payment_method,
       CAST(_amt AS DOUBLE) AS total_amount, (SELECT COUNT(*) FROM ({hist_sql})) AS total
FROM (SELECT transaction_id, customer_id, product_category, payment_method,
             transaction_date AS _ts, total_amount AS _amt FROM ({hist_sql}))
ORDER BY _ts DESC NULLS LAST, transaction_id DESC NULLS LAST, _amt DESC NULLS LAST,
         product_category ASC NULLS LAST, payment_method ASC NULLS LAST
LIMIT {limit} OFFSET {offset}"""
