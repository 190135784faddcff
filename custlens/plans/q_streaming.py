"""Registered queries: the live purchase stream.

Each query drives Structured Streaming to completion (``availableNow``) over the events table
and reads what the sinks hold.  One live run per (session, data folder) is shared by the
queries that read its prediction log."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from custlens import constants as K
from custlens.functions.exact import half_even_ratio_sql
from custlens.functions.text import ts_text, ts_text_sql
from custlens.operators import predicates as P
from custlens.operators import rfm
from custlens.plans import models as M
from custlens.plans.registry import register
from custlens.plans.training import training
from custlens.sources.feature_store import rfm_features
from custlens.session import scratch_path
from custlens.sources import tables as S
from custlens.streaming import live as V

RFM_STORED = rfm.rfm_sql(S.TX_SQL)
LIVE_ROWS_SQL = f"""SELECT transaction_id, customer_id, {ts_text_sql('transaction_date')} AS transaction_date,
    amount, CAST(total_amount AS DOUBLE) AS total_amount, status FROM ({S.LIVE_SQL})"""
LATEST_SHOWN = 50

_LOCK = threading.Lock()
_LIVE: dict = {}


def _live_rows(df):
    return df.select("transaction_id", "customer_id", ts_text("transaction_date").alias("transaction_date"),
                     "amount", F.col("total_amount").cast("double").alias("total_amount"), "status")


SHOWN_SEGMENTS = K.SEGMENT_NAMES[:3]


def closed_form_scorer(max_frequency: int):
    """A scorer that SQL reproduces: frequency over the largest stored frequency (at most 1), and
    a segment by the probability's band.  The pipeline takes any scorer; tests run the fitted one."""
    def scorer(feats):
        p = F.least(F.col("frequency") / F.lit(max_frequency), F.lit(1.0))
        will, p4 = P.purchase_decision(p)
        segment = F.when(p >= 0.7, 0).when(p >= 0.3, 1).otherwise(2)
        named = feats.withColumns({"segment_id": segment, "probability": p4, "will_purchase": will})
        named = named.withColumn("segment_name", F.get(F.array(*[F.lit(n) for n in SHOWN_SEGMENTS]), F.col("segment_id")))
        return named.select("transaction_id", "event_id", "customer_id", "amount", "transaction_date", "segment_id", "segment_name",
                            F.col("probability").alias("confidence"), "will_purchase", "probability", F.lit("closed form").alias("model_used"),
                            P.recommendation_for("segment_name").alias("recommendation"))
    return scorer


def _run_live(spark, sf_dir, stored, scorer):
    paths = V.LivePaths(*(scratch_path(spark, n) for n in ("live-history", "live-predictions", "live-stats", "live-latest")))
    V.run_live_pipeline(V.purchase_stream(spark, V.source_path(sf_dir)), paths, scratch_path(spark, "live-ckpt"), stored, scorer)
    return paths


def live_run(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _LIVE:
            stored = rfm_features(spark, sf_dir, "stored")
            top = stored.agg(F.max("frequency")).first()[0] or 1
            _LIVE[key] = _run_live(spark, sf_dir, stored, closed_form_scorer(top))
        return _LIVE[key]


def fitted_scorer(seg, model):
    """Segment and purchase probability by the fitted models."""
    keep = ["transaction_id", "event_id", "customer_id", "amount", "transaction_date"]
    return lambda feats: M.score_customers(feats, seg, model, model.name, keep=keep)


#: Every scored purchase, as the batch SQL of the whole stream.
PREDICTIONS_SQL = f"""SELECT *, {P.recommendation_sql('segment_name')} AS recommendation FROM (
    SELECT transaction_id, event_id, customer_id, amount, transaction_date, segment_id, ([{', '.join(f"'{n}'" for n in SHOWN_SEGMENTS)}])[segment_id + 1] AS segment_name,
           ROUND(p, 4) AS confidence, p > {K.DECISION_THRESHOLD} AS will_purchase, ROUND(p, 4) AS probability, 'closed form' AS model_used
    FROM (SELECT *, CAST(CASE WHEN p >= 0.7 THEN 0 WHEN p >= 0.3 THEN 1 ELSE 2 END AS INTEGER) AS segment_id FROM (
        SELECT l.*, LEAST(CAST(r.frequency + l.live_n AS DOUBLE) / (SELECT MAX(frequency) FROM ({RFM_STORED})), 1.0) AS p
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY event_id) AS live_n
              FROM ({S.LIVE_SQL.replace("SELECT 'TXN-'", "SELECT event_id, 'TXN-'")})) l JOIN ({RFM_STORED}) r USING (customer_id))))"""
LATEST_SQL = f"SELECT * FROM ({PREDICTIONS_SQL}) ORDER BY event_id DESC LIMIT {K.LIVE_LOG_CAP}"
STATS_SQL = f"""WITH l AS ({LATEST_SQL}),
    d AS (SELECT string_agg(segment_name || '=' || CAST(n AS VARCHAR), ',' ORDER BY segment_name) AS t FROM (SELECT segment_name, COUNT(*) AS n FROM l GROUP BY segment_name)),
    c AS (SELECT COUNT(*) AS total_predictions, COUNT(*) FILTER (WHERE will_purchase) AS will_purchase_count, CAST(SUM(CAST(ROUND(probability * 10000) AS BIGINT)) AS BIGINT) AS s FROM l)
    SELECT total_predictions, will_purchase_count, total_predictions - will_purchase_count AS will_not_purchase_count,
           CASE WHEN total_predictions = 0 THEN 0.0 ELSE {half_even_ratio_sql('s', 'total_predictions * 10000', 4)} END AS avg_probability, COALESCE(d.t, '') AS segments FROM c, d"""


def _stats_rows(st):
    entries = F.array_sort(F.map_entries("segment_distribution"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return st.select("total_predictions", "will_purchase_count", "will_not_purchase_count", "avg_probability", text.alias("segments"))


@register("stream_ingest", LIVE_ROWS_SQL)
def q_stream_ingest(spark, sf_dir):
    out = scratch_path(spark, "ingest")
    stream = V.purchase_stream(spark, V.source_path(sf_dir)).drop("event_id")
    V._run(stream.writeStream.format("parquet").option("path", out), scratch_path(spark, "ingest-ckpt"))
    return _live_rows(spark.read.parquet(out))


@register("stream_customer_state", f"""
WITH r AS ({RFM_STORED}),
s AS (SELECT user_id AS customer_id, COUNT(*) AS n_live, SUM(CAST(value AS DECIMAL(18,2))) AS live_sum
      FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT r.customer_id, CASE WHEN s.n_live IS NOT NULL THEN 0 ELSE r.recency END AS recency,
       r.frequency + COALESCE(s.n_live, 0) AS frequency,
       CAST(CAST(r.monetary AS DECIMAL(18,2)) + COALESCE(s.live_sum, 0) AS DOUBLE) AS monetary,
       r.avg_order_value, r.customer_lifetime_days, r.purchase_frequency, r.product_diversity
FROM r LEFT JOIN s ON r.customer_id = s.customer_id""")
def q_stream_customer_state(spark, sf_dir):
    out = scratch_path(spark, "customer-state")
    V.run_customer_state(V.purchase_stream(spark, V.source_path(sf_dir)), out, scratch_path(spark, "state-ckpt"))
    return V.updated_rfm(rfm_features(spark, sf_dir, "stored"), V.current_state(spark, out))


@register("stream_score", f"SELECT * REPLACE ({ts_text_sql('transaction_date')} AS transaction_date) FROM ({PREDICTIONS_SQL})")
def q_stream_score(spark, sf_dir):
    log = spark.read.parquet(live_run(spark, sf_dir).predictions).drop("batch_id")
    return log.withColumn("transaction_date", ts_text("transaction_date"))


@register("stream_append_history", LIVE_ROWS_SQL)
def q_stream_append_history(spark, sf_dir):
    return _live_rows(spark.read.parquet(live_run(spark, sf_dir).history))


@register("stream_latest", f"""SELECT transaction_id, customer_id, amount, {ts_text_sql('transaction_date')} AS timestamp, NULL::VARCHAR AS category,
    NULL::VARCHAR AS payment_method, segment_id, segment_name, confidence, will_purchase, probability, model_used, recommendation FROM ({LATEST_SQL})""")
def q_stream_latest(spark, sf_dir):
    """The records of the kept log, their nested fields spread out."""
    log = V.prediction_log_view(V.kept_log(spark, live_run(spark, sf_dir).latest))
    return log.select("transaction_id", "customer_id", "amount", "timestamp", "category", "payment_method", "segment.*", "prediction.*", "recommendation")


@register("latest_predictions", f"""SELECT transaction_id, customer_id, amount, {ts_text_sql('transaction_date')} AS timestamp
    FROM ({PREDICTIONS_SQL}) ORDER BY event_id DESC LIMIT {LATEST_SHOWN}""")
def q_latest_predictions(spark, sf_dir):
    top = V.latest_predictions(V.kept_log(spark, live_run(spark, sf_dir).latest), LATEST_SHOWN)
    return top.select("transaction_id", "customer_id", "amount", ts_text("transaction_date").alias("timestamp"))


@register("live_stats", STATS_SQL)
def q_live_stats(spark, sf_dir):
    return _stats_rows(V.live_stats(V.kept_log(spark, live_run(spark, sf_dir).latest)))


@register("stream_live_stats", STATS_SQL)
def q_stream_live_stats(spark, sf_dir):
    st = spark.read.parquet(live_run(spark, sf_dir).stats)
    return _stats_rows(st.orderBy(F.desc("batch_id")).limit(1))


@register("stream_score_fitted")
def q_stream_score_fitted(spark, sf_dir):
    """S3 with the trained segmentation and the default classifier."""
    run = training(spark, sf_dir)
    model = M.choose_model(run.tested.models, run.tested.best, None)
    paths = _run_live(spark, sf_dir, rfm_features(spark, sf_dir, "stored"), fitted_scorer(run.seg, model))
    return spark.read.parquet(paths.predictions).drop("batch_id").withColumn("transaction_date", ts_text("transaction_date"))
