"""Registered queries: sources presented as rows, predicates, defaults, lookups, joins
(A1, A7, A8, B1-B4, B6, B7, B10, B11, C2, C3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlens import constants as K
from custlens.functions.text import ts_text, ts_text_sql
from custlens.operators import labels as L
from custlens.operators import predicates as P
from custlens.operators import rfm
from custlens.plans.registry import register
from custlens.sources.feature_store import history_table, rfm_features
from custlens.sources import tables as S

H = S.HISTORY_SQL
RFM = rfm.rfm_sql(H)
RFM_STORED = rfm.rfm_sql(S.TX_SQL)  # the stored feature table, before live purchases
FEATS = ", ".join(K.FEATURES)


def _rfm(spark, sf_dir):
    return rfm_features(spark, sf_dir, "history")


def _tx_rows(df):
    return df.select("transaction_id", "customer_id", ts_text("transaction_date").alias("transaction_date"),
                     "product_category", "quantity", "unit_price",
                     F.col("total_amount").cast("double").alias("total_amount"), "payment_method")


@register("scan_table", f"""SELECT transaction_id, customer_id, {ts_text_sql('transaction_date')} AS transaction_date,
    product_category, quantity, unit_price, CAST(total_amount AS DOUBLE) AS total_amount, payment_method
    FROM ({S.TX_SQL})""")
def q_scan_table(spark, sf_dir):
    return _tx_rows(S.transactions(spark, sf_dir))


@register("append_live", f"""SELECT transaction_id, customer_id, {ts_text_sql('transaction_date')} AS transaction_date,
    product_category, CAST(total_amount AS DOUBLE) AS total_amount, amount, status FROM ({H})""")
def q_append_live(spark, sf_dir):
    h = S.history(spark, sf_dir)
    return h.select("transaction_id", "customer_id", ts_text("transaction_date").alias("transaction_date"),
                    "product_category", F.col("total_amount").cast("double").alias("total_amount"), "amount", "status")


_TURN = "CAST(regexp_extract(transaction_id, '([0-9]+)', 1) AS BIGINT) % 3"
_MIXED_SQL = f"""CASE WHEN status IS NULL THEN strftime(transaction_date, '%Y-%m-%d')
    WHEN {_TURN} = 0 THEN strftime(transaction_date, '%Y-%m-%d %H:%M:%S')
    WHEN {_TURN} = 1 THEN strftime(transaction_date, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(transaction_date, '%Y-%m-%d %H:%M') END"""


@register("parse_mixed_dates", f"""SELECT transaction_id, date_text,
    epoch_us(try_strptime(date_text, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d'])) AS parsed_us
    FROM (SELECT transaction_id, {_MIXED_SQL} AS date_text FROM ({H}))""")
def q_parse_mixed_dates(spark, sf_dir):
    h = history_table(spark, sf_dir).select("transaction_id", P.mixed_date_text().alias("date_text"))
    return h.select("transaction_id", "date_text", F.unix_micros(P.parse_mixed_dates("date_text")).alias("parsed_us"))


@register("feature_projection", f"SELECT customer_id, {FEATS} FROM ({RFM})")
def q_feature_projection(spark, sf_dir):
    return P.feature_projection(_rfm(spark, sf_dir))


#: Every feature in turn is null, NaN, Infinity or -Infinity for some customers.
_BAD = ["NULL", "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)"]
_DIRTY = "SELECT customer_id, " + ", ".join(
    f"CASE customer_id % 31 " + " ".join(f"WHEN {4 * i + j} THEN {bad}" for j, bad in enumerate(_BAD)) + f" ELSE CAST({c} AS DOUBLE) END AS {c}"
    for i, c in enumerate(K.FEATURES))


def _dirty(spark, sf_dir):
    return _rfm(spark, sf_dir).selectExpr(*_DIRTY.removeprefix("SELECT ").split(", "))


@register("clean_features", P.clean_features_sql(f"{_DIRTY} FROM ({RFM})", K.FEATURES, ["customer_id"]))
def q_clean_features(spark, sf_dir):
    return P.clean_features(_dirty(spark, sf_dir))


@register("nan_to_null", "SELECT customer_id, " + ", ".join(
    f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in K.FEATURES) + f" FROM ({_DIRTY} FROM ({RFM}))")
def q_nan_to_null(spark, sf_dir):
    return P.nan_to_null(_dirty(spark, sf_dir))


#: Requests that miss a field or hold text, a negative number or NaN; diversity is above 1 for some.
_ASKED = ["NULL", "'many'", "'-1'", "'NaN'", "''"]
_REQUESTS = "SELECT customer_id, model_name, " + ", ".join(
    f"CASE customer_id % 41 " + " ".join(f"WHEN {5 * i + j} THEN {bad}" for j, bad in enumerate(_ASKED))
    + (" WHEN 40 THEN '1.5'" if c == "product_diversity" else "") + f" ELSE {c} END AS {c}" for i, c in enumerate(K.FEATURES))


@register("validate_requests", P.validate_requests_sql(f"{_REQUESTS} FROM ({P.scoring_requests_sql(RFM)})"))
def q_validate_requests(spark, sf_dir):
    return P.validate_requests(P.scoring_requests(_rfm(spark, sf_dir)).selectExpr(*_REQUESTS.removeprefix("SELECT ").split(", ")))


@register("default_features_scoring", "SELECT customer_id, " + ", ".join(f"COALESCE({c}, 0.0) AS {c}" for c in K.FEATURES) + f" FROM ({_DIRTY} FROM ({RFM}))")
def q_default_features_scoring(spark, sf_dir):
    return P.default_features_scoring(_dirty(spark, sf_dir))


@register("normalize_model_name", f"""SELECT customer_id, model_name, {P.normalize_model_name_sql('model_name')} AS model_key
    FROM ({P.scoring_requests_sql(RFM)})""")
def q_normalize_model_name(spark, sf_dir):
    req = P.scoring_requests(_rfm(spark, sf_dir))
    return req.select("customer_id", "model_name", P.normalize_model_name("model_name").alias("model_key"))


_ENRICH_SQL = f"""SELECT l.transaction_id, l.customer_id, l.amount, {', '.join('r.' + c for c in K.FEATURES)},
    r.recency IS NOT NULL AS known_customer
    FROM ({S.LIVE_SQL}) l LEFT JOIN ({RFM_STORED}) r ON l.customer_id = r.customer_id"""


def _enriched(spark, sf_dir):
    live = S.live_purchases(spark, sf_dir).select("transaction_id", "customer_id", "amount")
    return P.enrich_live(live, rfm_features(spark, sf_dir, "stored"))


@register("enrich_live", _ENRICH_SQL)
def q_enrich_live(spark, sf_dir):
    return _enriched(spark, sf_dir)


@register("default_features", P.default_features_live_sql(_ENRICH_SQL, ["transaction_id", "customer_id", "amount",
                                                                         "known_customer"]))
def q_default_features(spark, sf_dir):
    return P.default_features_live(_enriched(spark, sf_dir))


@register("broadcast_scalar", f"""SELECT customer_id, recency, frequency, monetary,
    MAX(recency) OVER () AS max_recency, MAX(frequency) OVER () AS max_frequency, MAX(monetary) OVER () AS max_monetary
    FROM ({RFM})""")
def q_broadcast_scalar(spark, sf_dir):
    r = _rfm(spark, sf_dir).select("customer_id", "recency", "frequency", "monetary")
    return P.with_table_max(r, ["recency", "frequency", "monetary"])


_TARGET = L.purchase_target_sql(RFM)


@register("probability_band", f"SELECT customer_id, purchase_score, {P.probability_band_sql('purchase_score')} AS band FROM ({_TARGET})")
def q_probability_band(spark, sf_dir):
    t = L.purchase_target(_rfm(spark, sf_dir))
    return t.select("customer_id", "purchase_score", P.probability_band("purchase_score").alias("band"))


@register("purchase_decision", f"""SELECT customer_id, purchase_score > {K.DECISION_THRESHOLD} AS will_purchase,
    ROUND(purchase_score, 4) AS probability FROM ({_TARGET})""")
def q_purchase_decision(spark, sf_dir):
    t = L.purchase_target(_rfm(spark, sf_dir))
    will, prob = P.purchase_decision("purchase_score")
    return t.select("customer_id", will.alias("will_purchase"), prob.alias("probability"))
