"""Projections, cleaning, validation, defaults and lookups.

All of these are row-local ``Column`` expressions (whole-stage codegen, no shuffle) except
the lookups, which are joins against a small mapping table whose size is bounded by the
number of segments (<= 10), and C2, a key join Spark plans by measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens import constants as K

# ---------------------------------------------------------------- B1 / B2 / B3

def feature_projection(rfm: DataFrame, with_segment: bool = False, keep_id: bool = True) -> DataFrame:
    """B1: the model features in their fixed order (plus ``segment`` for the classifiers)."""
    cols = K.CLASSIFIER_FEATURES if with_segment else K.FEATURES
    return rfm.select(*(["customer_id"] if keep_id else []), *cols)


def clean_value(c: str) -> Column:
    """B2 for one column: null, NaN and +-Inf become 0 (as double)."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def clean_features(df: DataFrame, columns: list[str] = K.FEATURES) -> DataFrame:
    """B2: every listed feature cleaned, other columns unchanged."""
    return df.select(*[clean_value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def clean_features_sql(src: str, columns: list[str], keep: list[str]) -> str:
    def one(c):
        return (f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR abs(CAST({c} AS DOUBLE)) = 'inf'::DOUBLE "
                f"THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}")
    return f"SELECT {', '.join(keep + [one(c) for c in columns])} FROM ({src})"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating-point column."""
    fl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in fl else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- requests: B4 / B6 / B7

# fixed values: spellings the scoring requests carry for a model choice (null = default model)
REQUEST_MODEL_SPELLINGS = ["Random Forest", "xgboost", "LogisticRegression", "gradient boosting", None]


def scoring_requests(rfm: DataFrame) -> DataFrame:
    """One scoring request per customer row, fields as text (as a JSON body delivers them),
    with a requested model spelling chosen by customer id."""
    names = F.array(*[F.lit(n) if n is not None else F.lit(None).cast("string") for n in REQUEST_MODEL_SPELLINGS])
    pick = F.pmod(F.col("customer_id"), F.lit(len(REQUEST_MODEL_SPELLINGS))) + 1
    return rfm.select(
        "customer_id",
        *[F.col(c).cast("string").alias(c) for c in K.FEATURES],
        F.element_at(names, pick.cast("int")).alias("model_name"),
    )


def scoring_requests_sql(rfm_sql: str) -> str:
    arr = ", ".join(f"'{n}'" if n is not None else "NULL" for n in REQUEST_MODEL_SPELLINGS)
    fields = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in K.FEATURES)
    return (f"SELECT customer_id, {fields}, "
            f"([{arr}])[CAST(((customer_id % {len(REQUEST_MODEL_SPELLINGS)}) + {len(REQUEST_MODEL_SPELLINGS)}) "
            f"% {len(REQUEST_MODEL_SPELLINGS)} + 1 AS INTEGER)] AS model_name FROM ({rfm_sql})")


def validate_requests(req: DataFrame, fields: list[str] = K.FEATURES) -> DataFrame:
    """The first failing rule per request -> (customer_id, is_valid, reason).

    Rules in field order: present; numeric; >= 0; product_diversity <= 1.  Reasons follow the
    reference texts ("Missing required field: f", "Invalid value for f: v")."""
    checks = []
    for f in fields:
        raw = F.col(f).cast("string")
        num = F.expr(f"try_cast(`{f}` AS DOUBLE)")
        bad_range = (num < 0) | (F.lit(f == "product_diversity") & (num > 1))
        checks.append(
            F.when(F.col(f).isNull(), F.concat(F.lit("Missing required field: "), F.lit(f)))
             .when(num.isNull() | F.isnan(num) | bad_range, F.concat(F.lit(f"Invalid value for {f}: "), raw)))
    reason = F.coalesce(*checks)
    return req.select("customer_id", reason.isNull().alias("is_valid"), reason.alias("reason"))


def validate_requests_sql(req_sql: str, fields: list[str] = K.FEATURES) -> str:
    parts = []
    for f in fields:
        num = f"TRY_CAST({f} AS DOUBLE)"
        rng = f"{num} < 0" + (f" OR {num} > 1" if f == "product_diversity" else "")
        parts.append(f"CASE WHEN {f} IS NULL THEN 'Missing required field: {f}' "
                     f"WHEN {num} IS NULL OR isnan({num}) OR {rng} THEN 'Invalid value for {f}: ' || CAST({f} AS VARCHAR) END")
    reason = f"COALESCE({', '.join(parts)})"
    return f"SELECT customer_id, {reason} IS NULL AS is_valid, {reason} AS reason FROM ({req_sql})"


def normalize_model_name(c: Column | str) -> Column:
    """Lower-case, spaces removed; null -> ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.replace(F.lower(c), F.lit(" "), F.lit("")), F.lit(""))


def normalize_model_name_sql(e: str) -> str:
    return f"COALESCE(replace(lower({e}), ' ', ''), '')"


def default_features_scoring(df: DataFrame) -> DataFrame:
    """B7, scoring path: a missing feature is 0."""
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in K.FEATURES else F.col(c)
                       for c in df.columns])


def default_features_live(df: DataFrame) -> DataFrame:
    """B7, live path: avg_order_value -> monetary / max(frequency, 1); purchase_frequency -> 1.0;
    product_diversity -> 0.5; lifetime -> 30; recency, frequency, monetary -> 0."""
    mon = F.coalesce(F.col("monetary").cast("double"), F.lit(0.0))
    freq = F.coalesce(F.col("frequency"), F.lit(0).cast("long"))
    out = {
        "recency": F.coalesce(F.col("recency").cast("double"), F.lit(0.0)),
        "frequency": freq,
        "monetary": mon,
        "avg_order_value": F.coalesce(F.col("avg_order_value"), mon / F.greatest(freq, F.lit(1))),
        "purchase_frequency": F.coalesce(F.col("purchase_frequency"), F.lit(K.LIVE_DEFAULT_PURCHASE_FREQUENCY)),
        "product_diversity": F.coalesce(F.col("product_diversity"), F.lit(K.LIVE_DEFAULT_PRODUCT_DIVERSITY)),
        "customer_lifetime_days": F.coalesce(F.col("customer_lifetime_days"),
                                             F.lit(K.LIVE_DEFAULT_LIFETIME_DAYS).cast("long")),
    }
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def default_features_live_sql(src: str, keep: list[str]) -> str:
    mon = "COALESCE(CAST(monetary AS DOUBLE), 0.0)"
    freq = "COALESCE(frequency, 0)"
    cols = keep + [
        "COALESCE(CAST(recency AS DOUBLE), 0.0) AS recency",
        f"{freq} AS frequency",
        f"{mon} AS monetary",
        f"COALESCE(avg_order_value, {mon} / GREATEST({freq}, 1)) AS avg_order_value",
        f"COALESCE(purchase_frequency, {K.LIVE_DEFAULT_PURCHASE_FREQUENCY}) AS purchase_frequency",
        f"COALESCE(product_diversity, {K.LIVE_DEFAULT_PRODUCT_DIVERSITY}) AS product_diversity",
        f"COALESCE(customer_lifetime_days, {K.LIVE_DEFAULT_LIFETIME_DAYS}) AS customer_lifetime_days",
    ]
    return f"SELECT {', '.join(cols)} FROM ({src})"


# ---------------------------------------------------------------- lookups: B8 / B9

def segment_name_lookup(df: DataFrame, mapping: DataFrame, fallback: bool = True) -> DataFrame:
    """Segment id -> name; ``fallback`` gives "Segment {id}" for an unknown id (scoring path),
    otherwise null (report path).  ``mapping`` has one row per segment (<= 10): broadcast."""
    j = df.join(F.broadcast(mapping.select("segment", F.col("segment_name").alias("_name"))), "segment", "left")
    name = F.coalesce(F.col("_name"), F.concat(F.lit("Segment "), F.col("segment").cast("string"))) if fallback \
        else F.col("_name")
    return j.withColumn("segment_name", name).drop("_name")


def recommendation_for(name: Column | str) -> Column:
    """Segment name -> action text, with the default text."""
    name = F.col(name) if isinstance(name, str) else name
    m = F.create_map(*[x for k, v in K.RECOMMENDATIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, name), F.lit(K.DEFAULT_RECOMMENDATION))


def recommendation_sql(e: str) -> str:
    whens = " ".join(f"WHEN {e} = '{k}' THEN '{v}'" for k, v in K.RECOMMENDATIONS.items())
    return f"CASE {whens} ELSE '{K.DEFAULT_RECOMMENDATION}' END"


# ---------------------------------------------------------------- B10 / B11

def probability_band(p: Column | str) -> Column:
    """0-30 / 30-70 / 70-100 % bands (upper bounds exclusive, 1.0 in the top band)."""
    p = F.col(p) if isinstance(p, str) else p
    (_, hi0, n0), (_, hi1, n1), (_, _, n2) = K.PROBABILITY_BANDS
    return F.when(p < hi0, F.lit(n0)).when(p < hi1, F.lit(n1)).when(p.isNotNull(), F.lit(n2))


def probability_band_sql(e: str) -> str:
    (_, hi0, n0), (_, hi1, n1), (_, _, n2) = K.PROBABILITY_BANDS
    return f"CASE WHEN {e} < {hi0} THEN '{n0}' WHEN {e} < {hi1} THEN '{n1}' WHEN {e} IS NOT NULL THEN '{n2}' END"


def purchase_decision(p: Column | str) -> tuple[Column, Column]:
    """(will_purchase, probability rounded to 4 dp)."""
    p = F.col(p) if isinstance(p, str) else p
    return (p > K.DECISION_THRESHOLD), F.round(p, 4)


# ---------------------------------------------------------------- A7

def parse_mixed_dates(c: Column | str) -> Column:
    """Dates, with or without a time (seconds, fractions and the ISO ``T`` are optional) ->
    timestamp, else null.  One cast; the pattern keeps out texts that the cast would complete
    with today's date or a first of January."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"), c.try_cast("timestamp"))


def mixed_date_text() -> Column:
    """Dates as the reference's tables hold them, and the other forms it reads: stored rows as
    'yyyy-MM-dd'; live rows, by their number, with seconds, in ISO form or to the minute."""
    turn = F.regexp_extract("transaction_id", r"(\d+)", 1).cast("long") % 3
    text = lambda f: F.date_format("transaction_date", f)
    return (F.when(F.col("status").isNull(), text("yyyy-MM-dd"))
             .when(turn == 0, text("yyyy-MM-dd HH:mm:ss"))
             .when(turn == 1, text("yyyy-MM-dd'T'HH:mm:ss"))
             .otherwise(text("yyyy-MM-dd HH:mm")))


# ---------------------------------------------------------------- C2 / C3

def enrich_live(live: DataFrame, rfm: DataFrame) -> DataFrame:
    """Each live purchase with its customer's stored features (null for unknown customers).

    A key join; Spark broadcasts the RFM side only while its measured size is under the
    broadcast threshold and shuffles both sides otherwise (AQE splits skewed keys)."""
    feats = rfm.select("customer_id", *K.FEATURES)
    return live.join(feats, "customer_id", "left").withColumn("known_customer", F.col("recency").isNotNull())


def with_table_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole-table maxima attached to every row via one scalar subquery (no shuffle of
    ``df``, no single-partition window)."""
    mx = df.select(F.struct(*[F.max(c).alias(c) for c in columns])).scalar()
    return df.withColumn("_mx", mx).select(*df.columns, *[F.col(f"_mx.{c}").alias(f"max_{c}") for c in columns])
