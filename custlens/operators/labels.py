"""The purchase label and the train/test split.

Whole-table maxima are scalar subqueries (C3), never single-partition windows.  The split
ranks customers inside their class by a seeded 31-bit integer hash (SQL reproduces it bit for
bit); ranks are exact and computed over 4096 hash ranges, so even a class holding most rows
is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens import constants as K
from custlens.functions.ranking import hash_rank_within

NORMALIZED = ["frequency", "purchase_frequency", "monetary"]


def max_normalize(df: DataFrame, columns: list[str] = NORMALIZED) -> DataFrame:
    """Each column divided by its whole-table maximum (null when the maximum is 0)."""
    mx = df.select(F.struct(*[F.max(c).alias(c) for c in columns])).scalar()
    return df.withColumn("_mx", mx).select(
        "customer_id", *[F.try_divide(F.col(c).cast("double"), F.col(f"_mx.{c}")).alias(f"{c}_norm") for c in columns])


def max_normalize_sql(src: str, columns: list[str] = NORMALIZED) -> str:
    cols = ", ".join(f"CASE WHEN m.{c} = 0 THEN NULL ELSE CAST(s.{c} AS DOUBLE) / m.{c} END AS {c}_norm"
                     for c in columns)
    mx = ", ".join(f"MAX({c}) AS {c}" for c in columns)
    return f"SELECT s.customer_id, {cols} FROM ({src}) s, (SELECT {mx} FROM ({src})) m"


def _raw_propensity(mf: Column, mpf: Column) -> Column:
    w_r, w_f, w_pf = K.TARGET_WEIGHTS
    return ((F.lit(1.0) / (F.col("recency") + 1)) * w_r
            + F.try_divide(F.col("frequency").cast("double"), mf) * w_f
            + F.try_divide(F.col("purchase_frequency").cast("double"), mpf) * w_pf)


def purchase_target(rfm: DataFrame) -> DataFrame:
    """Rule-built label.  p = 0.4/(R+1) + 0.3 F/maxF + 0.3 PF/maxPF; label = p/max(p) > 0.4.

    Returns (customer_id, purchase_score = p / max p, will_purchase int)."""
    mx = rfm.select(F.struct(F.max("frequency").alias("f"), F.max("purchase_frequency").alias("pf"))).scalar()
    with_p = rfm.withColumn("_mx", mx).withColumn("_p", _raw_propensity(F.col("_mx.f"), F.col("_mx.pf")))
    mp = with_p.select(F.max("_p")).scalar()
    score = F.try_divide(F.col("_p"), F.col("_mp"))
    return with_p.withColumn("_mp", mp).select("customer_id", score.alias("purchase_score"),
                         (score > K.TARGET_THRESHOLD).cast("int").alias("will_purchase"))


def purchase_target_sql(rfm_sql: str) -> str:
    w_r, w_f, w_pf = K.TARGET_WEIGHTS
    return f"""
WITH r AS ({rfm_sql}),
m AS (SELECT MAX(frequency) AS f, MAX(purchase_frequency) AS pf FROM r),
p AS (SELECT customer_id,
             (1.0::DOUBLE / (recency + 1)) * {w_r}::DOUBLE + (CAST(frequency AS DOUBLE) / m.f) * {w_f}::DOUBLE
             + (CAST(purchase_frequency AS DOUBLE) / m.pf) * {w_pf}::DOUBLE AS p FROM r, m)
SELECT customer_id, p / (SELECT MAX(p) FROM p) AS purchase_score,
       CAST(p / (SELECT MAX(p) FROM p) > {K.TARGET_THRESHOLD} AS INTEGER) AS will_purchase FROM p"""


def scored_customers(rfm: DataFrame, decision: float = K.DECISION_THRESHOLD) -> DataFrame:
    """(customer_id, label, score, prediction): the E3 label against a closed-form score
    (frequency / max frequency, E2) thresholded at ``decision`` - one projection, no join."""
    mx = rfm.select(F.struct(F.max("frequency").alias("f"), F.max("purchase_frequency").alias("pf"))).scalar()
    with_p = rfm.withColumn("_mx", mx).withColumn("_p", _raw_propensity(F.col("_mx.f"), F.col("_mx.pf")))
    mp = with_p.select(F.max("_p")).scalar()
    with_p = with_p.withColumn("_mp", mp).withColumn("_score", F.try_divide(F.col("frequency").cast("double"), F.col("_mx.f")))
    return with_p.select("customer_id",
                         (F.try_divide(F.col("_p"), F.col("_mp")) > K.TARGET_THRESHOLD).cast("int").alias("label"),
                         F.col("_score").alias("score"), (F.col("_score") > decision).cast("int").alias("prediction"))


def scored_customers_sql(rfm_sql: str, decision: float = K.DECISION_THRESHOLD) -> str:
    return f"""
SELECT t.customer_id, t.will_purchase AS label, CAST(r.frequency AS DOUBLE) / m.f AS score,
       CAST(CAST(r.frequency AS DOUBLE) / m.f > {decision} AS INTEGER) AS prediction
FROM ({purchase_target_sql(rfm_sql)}) t JOIN ({rfm_sql}) r USING (customer_id),
     (SELECT MAX(frequency) AS f FROM ({rfm_sql})) m"""


def target_distribution(labels: DataFrame) -> DataFrame:
    """Customers per label."""
    return labels.groupBy("will_purchase").agg(F.count(F.lit(1)).alias("customers"))


def target_distribution_sql(labels_sql: str) -> str:
    return f"SELECT will_purchase, COUNT(*) AS customers FROM ({labels_sql}) GROUP BY will_purchase"


# Fixed values of the split hash, an integer mix that Spark and SQL engines compute bit for bit
# (every intermediate stays below 2^48, so ANSI overflow checks never fire):
# modulus 2^31 - 1; per round multiply by 48271 then 69621, xor with itself shifted right by
# 13 then 17 bits.
SPLIT_MOD = 2147483647
SPLIT_MULTIPLIERS = (48271, 69621)
SPLIT_SHIFTS = (13, 17)
SPLIT_HASH_BITS = 31


def _split_key(seed: int) -> Column:
    """Seeded 31-bit hash of ``customer_id``: modular multiply + xor-shift, twice."""
    x = F.pmod(F.col("customer_id").cast("long"), F.lit(SPLIT_MOD))
    for m, s in zip(SPLIT_MULTIPLIERS, SPLIT_SHIFTS):
        x = F.pmod(x * F.lit(m) + F.lit(seed), F.lit(SPLIT_MOD))
        x = x.bitwiseXOR(F.shiftright(x, s))
    return x


def split_hash_sql(src_sql: str, seed: int) -> str:
    """SQL twin of ``_split_key``: ``src_sql`` with an added column ``_h``."""
    q = f"SELECT *, ((CAST(customer_id AS BIGINT) % {SPLIT_MOD}) + {SPLIT_MOD}) % {SPLIT_MOD} AS _h FROM ({src_sql})"
    for m, s in zip(SPLIT_MULTIPLIERS, SPLIT_SHIFTS):
        q = f"SELECT * REPLACE ((_h * {m} + {seed}) % {SPLIT_MOD} AS _h) FROM ({q})"
        q = f"SELECT * REPLACE (xor(_h, _h // {1 << s}) AS _h) FROM ({q})"
    return q


def split_quotas(labels: DataFrame, label: str = "will_purchase", test_fraction: float = K.TEST_FRACTION) -> DataFrame:
    """Test rows per class: total ceil(f * n), shared by largest remainder (ties: smaller label).
    Input is one row per class (at most a handful), so the window here is over that tiny table."""
    from pyspark.sql import Window
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy()
    c = counts.withColumn("n", F.sum("n_c").over(w_all))
    c = c.withColumn("total_test", F.ceil(F.col("n") * F.lit(test_fraction)).cast("long"))
    product = F.col("total_test").cast("decimal(19,0)") * F.col("n_c").cast("decimal(19,0)")  # beyond a long at 4e9 rows
    c = c.withColumn("rem", product % F.col("n"))
    c = c.withColumn("base", ((product - F.col("rem")) / F.col("n")).cast("long"))
    c = c.withColumn("left", F.col("total_test") - F.sum("base").over(w_all))
    c = c.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("rem"), F.asc(label))))
    return c.select(label, "n_c", (F.col("base") + F.when(F.col("ord") <= F.col("left"), 1).otherwise(0))
                    .alias("n_test"))


def stratified_split(labels: DataFrame, label: str = "will_purchase", seed: int = K.SEED,
                     test_fraction: float = K.TEST_FRACTION) -> DataFrame:
    """(customer_id, label, is_test) with exact per-class test quotas."""
    ranked = hash_rank_within(labels.select("customer_id", label), label, _split_key(seed), tiebreak="customer_id",
                              hash_bits=SPLIT_HASH_BITS)
    q = split_quotas(labels, label, test_fraction)
    return (ranked.join(F.broadcast(q.select(label, "n_test")), label)  # one row per class
                  .select("customer_id", label, (F.col("rank") < F.col("n_test")).alias("is_test")))


def stratified_folds(labels: DataFrame, label: str = "will_purchase", folds: int = K.CV_FOLDS,
                     seed: int = K.SEED) -> DataFrame:
    """E5: fold 0..folds-1 per customer; each class is dealt round-robin in hash order, so
    fold sizes per class differ by at most one."""
    ranked = hash_rank_within(labels.select("customer_id", label), label, _split_key(seed + 1),
                              tiebreak="customer_id", hash_bits=SPLIT_HASH_BITS)
    return ranked.select("customer_id", label, F.pmod(F.col("rank"), F.lit(folds)).cast("int").alias("fold"))


def stratified_split_sql(labels_sql: str, label: str = "will_purchase", seed: int = K.SEED,
                         test_fraction: float = K.TEST_FRACTION) -> str:
    return f"""
WITH t AS ({labels_sql}),
c AS (SELECT {label}, COUNT(*) AS n_c FROM t GROUP BY {label}),
a AS (SELECT {label}, n_c, SUM(n_c) OVER () AS n,
             CAST(CEIL(CAST(SUM(n_c) OVER () AS DOUBLE) * CAST({test_fraction} AS DOUBLE)) AS BIGINT) AS total_test
      FROM c),
b AS (SELECT {label}, total_test, CAST(FLOOR(total_test * n_c / n) AS BIGINT) AS base,
             total_test * n_c / n - CAST(FLOOR(total_test * n_c / n) AS BIGINT) AS rem FROM a),
q AS (SELECT {label}, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, {label})
                                       <= total_test - SUM(base) OVER () THEN 1 ELSE 0 END AS n_test FROM b),
r AS (SELECT customer_id, {label}, ROW_NUMBER() OVER (PARTITION BY {label} ORDER BY _h, customer_id) - 1 AS rnk
      FROM ({split_hash_sql(f"SELECT customer_id, {label} FROM t", seed)}))
SELECT r.customer_id, r.{label}, r.rnk < q.n_test AS is_test FROM r JOIN q USING ({label})"""


def stratified_folds_sql(labels_sql: str, label: str = "will_purchase", folds: int = K.CV_FOLDS,
                         seed: int = K.SEED) -> str:
    return f"""
SELECT customer_id, {label},
       CAST((ROW_NUMBER() OVER (PARTITION BY {label} ORDER BY _h, customer_id) - 1) % {folds} AS INTEGER) AS fold
FROM ({split_hash_sql(f"SELECT customer_id, {label} FROM ({labels_sql})", seed + 1)})"""
