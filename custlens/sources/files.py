"""File sources and sinks (A2-A6): CSV in and out, table replacement, the CSV -> table job,
and the customer-keyed layout.  All paths live under the shared folder the session names."""

from __future__ import annotations

import logging
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from custlens.session import delete_at_exit, scratch_path

log = logging.getLogger(__name__)

RFM_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("recency", T.LongType()),
    T.StructField("frequency", T.LongType()),
    T.StructField("monetary", T.DoubleType()),
    T.StructField("avg_order_value", T.DoubleType()),
    T.StructField("customer_lifetime_days", T.LongType()),
    T.StructField("purchase_frequency", T.DoubleType()),
    T.StructField("product_diversity", T.DoubleType()),
])


#: Timestamps to the microsecond, quotes doubled inside quotes, null apart from the empty text.
CSV_OPTIONS = {"header": True, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "escape": '"', "nullValue": "\\N"}


def write_csv(df: DataFrame, path: str) -> str:
    """A4: CSV with a header row, no index column; one file per partition (no single writer)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False) -> DataFrame:
    """A2: CSV with a header -> table, with an explicit schema (no inference pass).  Files are split
    among tasks.  ``line_breaks``: quoted text may hold line breaks, so that a file must be
    read by one task; without it such a file is an error, not other rows."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=line_breaks, mode="FAILFAST").csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """A3: replace a stored table (Parquet)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def migrate_csv(spark: SparkSession, tx_csv: str, rfm_csv: str, tx_schema: T.StructType,
                tx_table: str, rfm_table: str, line_breaks: bool = False) -> dict:
    """A5: CSV -> tables.  A missing transactions file is a warning, a missing RFM file aborts.
    Returns the row counts written (they equal the counts read)."""
    if not path_exists(spark, rfm_csv):
        raise FileNotFoundError(f"RFM CSV not found: {rfm_csv}")
    out = {}
    if path_exists(spark, tx_csv):
        write_table(scan_csv(spark, tx_csv, tx_schema, line_breaks), tx_table)
        out["transactions"] = spark.read.parquet(tx_table).count()
    else:
        log.warning("transactions CSV not found: %s", tx_csv)
    write_table(scan_csv(spark, rfm_csv, RFM_SCHEMA), rfm_table)
    out["rfm_features"] = spark.read.parquet(rfm_table).count()
    return out


ROWS_PER_BUCKET = 2_000_000


def bucket_count(rows: int) -> int:
    """Buckets for a table of ``rows`` rows: about ``ROWS_PER_BUCKET`` each, 8 at least."""
    return max(8, -(-rows // ROWS_PER_BUCKET))


def layout_by_customer(df: DataFrame, name: str, path: str, buckets: int) -> str:
    """The reference's customer_id index re-aimed as data layout: a bucketed, sorted table,
    so later joins and aggregations on customer_id read co-partitioned data without a shuffle."""
    (df.write.mode("overwrite").format("parquet").option("path", path)
       .bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(name))
    return name


@contextmanager
def customer_layout(spark: SparkSession, tables: dict[str, DataFrame]):
    """The given tables laid out by customer (A6) in equally many buckets, by name; they go when the
    block ends.  Joins and aggregations on the customer read them without an exchange."""
    tag = uuid.uuid4().hex[:12]   # runs do not overwrite each other's tables
    buckets = bucket_count(max(df.count() for df in tables.values()))
    names = {n: f"{n}_by_customer_{tag}" for n in tables}
    try:
        for n, df in tables.items():
            layout_by_customer(df, names[n], delete_at_exit(spark, scratch_path(spark, names[n])), buckets)
        yield {n: spark.table(t) for n, t in names.items()}
    finally:
        for t in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {t}")
