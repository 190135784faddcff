"""Registered queries: CSV and table sinks read back, the migration job and the bucketed
layout (A2-A6).  Everything is written under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.functions.text import ts_text, ts_text_sql
from custlens.operators import affinity as A
from custlens.operators import rfm
from custlens.plans.registry import register
from custlens.sources.feature_store import history_table, rfm_features
from custlens.functions.materialize import materialize
from custlens.session import scratch_path
from custlens.sources import files
from custlens.sources import tables as S

H = S.HISTORY_SQL
RFM = rfm.rfm_sql(H)
TX_ROWS_SQL = f"""SELECT transaction_id, customer_id, {ts_text_sql('transaction_date')} AS transaction_date,
    product_category, quantity, unit_price, CAST(total_amount AS DOUBLE) AS total_amount, payment_method
    FROM ({S.TX_SQL})"""


def _tx_rows(df):
    return df.select("transaction_id", "customer_id", ts_text("transaction_date").alias("transaction_date"),
                     "product_category", "quantity", "unit_price",
                     F.col("total_amount").cast("double").alias("total_amount"), "payment_method")


HISTORY_SCHEMA = T.StructType([*S.TRANSACTION_SCHEMA.fields, T.StructField("amount", T.DoubleType()), T.StructField("status", T.StringType())])


@register("write_csv", f"""SELECT transaction_id, customer_id, {ts_text_sql('transaction_date')} AS transaction_date,
    product_category, CAST(total_amount AS DOUBLE) AS total_amount, payment_method, amount, status FROM ({H})""")
def q_write_csv(spark, sf_dir):
    """The history, live rows with their microseconds included, written and read back."""
    path = files.write_csv(history_table(spark, sf_dir), scratch_path(spark, "history-csv"))
    back = files.scan_csv(spark, path, HISTORY_SCHEMA)
    return back.select("transaction_id", "customer_id", ts_text("transaction_date").alias("transaction_date"), "product_category",
                       F.col("total_amount").cast("double").alias("total_amount"), "payment_method", "amount", "status")


@register("scan_csv", TX_ROWS_SQL)
def q_scan_csv(spark, sf_dir):
    path = files.write_csv(S.transactions(spark, sf_dir), scratch_path(spark, "tx-csv"))
    return _tx_rows(files.scan_csv(spark, path, S.TRANSACTION_SCHEMA))


@register("write_table", RFM)
def q_write_table(spark, sf_dir):
    path = files.write_table(rfm_features(spark, sf_dir, "history"), scratch_path(spark, "rfm-table"))
    return spark.read.parquet(path)


_CONTENT = "COUNT(*) AS rows, COUNT(DISTINCT customer_id) AS customers, CAST(SUM(CAST({} AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents"


@register("migrate_csv", f"""SELECT 'transactions' AS table_name, {_CONTENT.format('total_amount')}, MAX(epoch_us(transaction_date)) AS last_us FROM ({H})
    UNION ALL SELECT 'rfm_features', {_CONTENT.format('monetary')}, CAST(SUM(recency) AS BIGINT) FROM ({RFM})""")
def q_migrate_csv(spark, sf_dir):
    """Both tables through CSV; what the written tables hold."""
    tx_csv = files.write_csv(history_table(spark, sf_dir), scratch_path(spark, "tx-csv"))
    rfm_csv = files.write_csv(rfm_features(spark, sf_dir, "history"), scratch_path(spark, "rfm-csv"))
    tx, features = scratch_path(spark, "tx-table"), scratch_path(spark, "rfm-table")
    files.migrate_csv(spark, tx_csv, rfm_csv, HISTORY_SCHEMA, tx, features)

    def content(name, path, amount, last):
        return spark.read.parquet(path).agg(
            F.count(F.lit(1)).alias("rows"), F.countDistinct("customer_id").alias("customers"),
            F.sum(F.col(amount).cast("decimal(18,2)") * 100).cast("long").alias("cents"), last.alias("last_us")).select(F.lit(name).alias("table_name"), "*")
    return content("transactions", tx, "total_amount", F.max(F.unix_micros("transaction_date"))) \
        .unionByName(content("rfm_features", features, "monetary", F.sum("recency")))


@register("layout_by_customer", f"""SELECT r.*, t.n_transactions FROM ({RFM}) r
    JOIN (SELECT customer_id, COUNT(*) AS n_transactions FROM ({H}) GROUP BY customer_id) t USING (customer_id)""")
def q_layout_by_customer(spark, sf_dir):
    """Both tables laid out by customer and joined on it: neither side is shuffled."""
    with files.customer_layout(spark, {"rfm": rfm_features(spark, sf_dir, "history"), "tx": history_table(spark, sf_dir)}) as t:
        counts = t["tx"].groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_transactions"))
        return materialize(t["rfm"].join(counts, "customer_id"), "layout-join")


@register("rfm_from_layout", RFM)
def q_rfm_from_layout(spark, sf_dir):
    """D8 from the history laid out by customer: no row is moved to its customer."""
    with files.customer_layout(spark, {"tx": history_table(spark, sf_dir)}) as t:
        return materialize(rfm.rfm_table(t["tx"], in_place=True), "layout-rfm")


@register("affinity_from_layout", A.category_affinity_sql(H))
def q_affinity_from_layout(spark, sf_dir):
    """C1 from the history laid out by customer."""
    with files.customer_layout(spark, {"tx": history_table(spark, sf_dir)}) as t:
        return materialize(A.category_affinity(t["tx"]), "layout-affinity")
