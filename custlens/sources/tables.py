"""Table sources (A1) and the engine views built on the supplied tables.

``transactions`` maps the order tables onto the engine's transaction schema; ``live_purchases``
maps purchase events onto the live-purchase schema; ``history`` is their union (A8).
Every view is a lazy DataFrame: filters and projections applied later reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.functions.exact import money

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("transaction_date", T.TimestampType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("total_amount", T.DecimalType(18, 2)),
    T.StructField("payment_method", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def scan_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1: full scan of a stored table (column pruning and filters reach the scan later)."""
    return spark.read.parquet(table_path(sf_dir, name))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ part, in the engine's transaction schema.

    Two equi-joins on the tables' keys; Spark picks broadcast vs sort-merge from measured
    sizes (``part`` is broadcast only while it is under the broadcast threshold).
    """
    li = scan_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    od = scan_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    pt = scan_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(pt, li.l_partkey == pt.p_partkey))
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
         .alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_date"),
        F.col("p_type").alias("product_category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        money("l_extendedprice").alias("total_amount"),
        F.col("o_orderpriority").alias("payment_method"),
    )


def purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")


def to_live_schema(events: DataFrame) -> DataFrame:
    """Purchase events -> live transaction rows (works on batch and streaming frames)."""
    return events.select(
        F.concat(F.lit("TXN-"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("transaction_date"),
        F.col("value").alias("amount"),
        money("value").alias("total_amount"),
        F.lit("completed").alias("status"),
    )


def live_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_live_schema(purchase_events(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 applied: stored transactions plus live purchases, missing columns null."""
    return transactions(spark, sf_dir).unionByName(live_purchases(spark, sf_dir), allowMissingColumns=True)


# ---- oracle SQL twins (DuckDB; the supplied tables are pre-registered views) ----

TX_SQL = """
SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS transaction_id,
       o.o_custkey AS customer_id,
       o.o_orderdate AS transaction_date,
       p.p_type AS product_category,
       CAST(l.l_quantity AS INTEGER) AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS total_amount,
       o.o_orderpriority AS payment_method
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                JOIN part p ON l.l_partkey = p.p_partkey
"""

LIVE_SQL = """
SELECT 'TXN-' || CAST(event_id AS VARCHAR) AS transaction_id,
       user_id AS customer_id,
       ts AS transaction_date,
       value AS amount,
       CAST(value AS DECIMAL(18,2)) AS total_amount,
       'completed' AS status
FROM events WHERE event_type = 'purchase'
"""

HISTORY_SQL = f"""
SELECT transaction_id, customer_id, transaction_date, product_category, quantity, unit_price,
       total_amount, payment_method, NULL::DOUBLE AS amount, NULL::VARCHAR AS status FROM ({TX_SQL})
UNION ALL
SELECT transaction_id, customer_id, transaction_date, NULL, NULL, NULL,
       total_amount, NULL, amount, status FROM ({LIVE_SQL})
"""
