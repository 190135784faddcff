"""Classifier evaluation on (label, score[, prediction]) tables.

Scores are first grouped by distinct value (one row per score), so ties collapse and the
curve's size is the number of distinct scores.  Running counts use range-partitioned prefix
sums (``ordered_prefix_sums``), never a single global window over all rows.  Ratios are
exact integer half-even roundings (identical in every engine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.exact import half_even_ratio, half_even_ratio_sql
from custlens.functions.ranking import ordered_prefix_sums


def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score",
              drop_intermediate: bool = True) -> DataFrame:
    """(point, threshold, fpr, tpr) by descending distinct score with (0, 0) first at an
    infinite threshold; collinear interior points dropped."""
    sc = score_counts(scored, label, score)
    cum = ordered_prefix_sums(sc.withColumn("one", F.lit(1)), "score", ["pos", "neg", "one"], descending=True)
    pts = cum.select(F.col("score").alias("threshold"), F.col("cum_pos").alias("tps"),
                     F.col("cum_neg").alias("fps"), (F.col("cum_one") - 1).alias("idx"))
    tot = sc.select(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count(F.lit(1)).alias("d"))).scalar()
    if drop_intermediate:
        prev = pts.select((F.col("idx") + 1).alias("idx"), F.col("tps").alias("tp_prev"), F.col("fps").alias("fp_prev"))
        nxt = pts.select((F.col("idx") - 1).alias("idx"), F.col("tps").alias("tp_next"), F.col("fps").alias("fp_next"))
        j = pts.join(prev, "idx", "left").join(nxt, "idx", "left")
        keep = (F.col("tp_prev").isNull() | F.col("tp_next").isNull()
                | (F.col("fp_next") - 2 * F.col("fps") + F.col("fp_prev") != 0)
                | (F.col("tp_next") - 2 * F.col("tps") + F.col("tp_prev") != 0))
        pts = j.where(keep).select("idx", "threshold", "tps", "fps")
    start = pts.sparkSession.range(1).select(F.lit(-1).cast("long").alias("idx"), F.lit(float("inf")).alias("threshold"),
                                             F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"))
    allp = start.unionByName(pts.select("idx", "threshold", "tps", "fps"))
    return allp.select(
        F.col("idx").alias("order_key"), "threshold",
        F.try_divide(F.col("fps").cast("double"), tot["n"].cast("double")).alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), tot["p"].cast("double")).alias("tpr"))


def roc_curve_sql(scored_sql: str, label: str = "label", score: str = "score") -> str:
    return f"""
WITH sc AS (SELECT {score} AS score, COUNT(*) FILTER (WHERE {label} = 1) AS pos,
                   COUNT(*) FILTER (WHERE {label} <> 1) AS neg FROM ({scored_sql}) GROUP BY {score}),
c AS (SELECT score AS threshold, SUM(pos) OVER w AS tps, SUM(neg) OVER w AS fps,
             ROW_NUMBER() OVER w - 1 AS idx
      FROM sc WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, LAG(tps) OVER o AS tp_prev, LEAD(tps) OVER o AS tp_next,
             LAG(fps) OVER o AS fp_prev, LEAD(fps) OVER o AS fp_next FROM c WINDOW o AS (ORDER BY idx)),
pts AS (SELECT idx, threshold, tps, fps FROM k
        WHERE tp_prev IS NULL OR tp_next IS NULL OR fp_next - 2 * fps + fp_prev <> 0
              OR tp_next - 2 * tps + tp_prev <> 0
        UNION ALL SELECT -1, 'inf'::DOUBLE, 0, 0),
t AS (SELECT SUM(pos) AS p, SUM(neg) AS n FROM sc)
SELECT CAST(idx AS BIGINT) AS order_key, threshold,
       CASE WHEN t.n = 0 THEN NULL ELSE CAST(fps AS DOUBLE) / CAST(t.n AS DOUBLE) END AS fpr,
       CASE WHEN t.p = 0 THEN NULL ELSE CAST(tps AS DOUBLE) / CAST(t.p AS DOUBLE) END AS tpr
FROM pts, t"""


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half (the Mann-Whitney form).

    sum over distinct scores of pos * (2 * neg strictly below + neg), divided by 2 * P * N, in
    decimals: exact and order-independent for any counts; null without both classes."""
    sc = score_counts(scored, label, score)
    cum = ordered_prefix_sums(sc, "score", ["neg"], descending=False, inclusive=False)
    wide = lambda c: c.cast("decimal(19,0)")
    return cum.agg(
        F.try_divide(F.sum(wide(F.col("pos")) * wide(2 * F.col("cum_neg") + F.col("neg"))).cast("double"),
                     (2 * wide(F.sum("pos")) * wide(F.sum("neg"))).cast("double")).alias("auc"))


def auc_sql(scored_sql: str, label: str = "label", score: str = "score") -> str:
    return f"""
WITH sc AS (SELECT {score} AS score, COUNT(*) FILTER (WHERE {label} = 1) AS pos,
                   COUNT(*) FILTER (WHERE {label} <> 1) AS neg FROM ({scored_sql}) GROUP BY {score}),
c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM sc)
SELECT CASE WHEN SUM(pos) * SUM(neg) = 0 THEN NULL
            ELSE SUM(pos * (below + neg * 0.5)) / CAST(SUM(pos) * SUM(neg) AS DOUBLE) END AS auc FROM c"""


CELLS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts by (actual, predicted) for the 2x2 cells, missing cells 0."""
    counts = pred.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")) \
                 .agg(F.count(F.lit(1)).alias("n"))
    cells = pred.sparkSession.createDataFrame(CELLS, "actual int, predicted int")  # the fixed 2x2 grid
    return cells.join(counts, ["actual", "predicted"], "left") \
                .select("actual", "predicted", F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"))


def confusion_matrix_sql(pred_sql: str, label: str = "label", prediction: str = "prediction") -> str:
    return f"""
SELECT g.actual, g.predicted, COALESCE(c.n, 0) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)
LEFT JOIN (SELECT CAST({label} AS INTEGER) AS actual, CAST({prediction} AS INTEGER) AS predicted, COUNT(*) AS n
           FROM ({pred_sql}) GROUP BY 1, 2) c ON c.actual = g.actual AND c.predicted = g.predicted"""


AXIS_NAMES = {0: "No", 1: "Yes"}


def confusion_long(cm: DataFrame) -> DataFrame:
    """Labelled confusion cells ('Actual: No' x 'Predicted: Yes' ...)."""
    name = lambda c: F.when(F.col(c) == 1, F.lit(AXIS_NAMES[1])).otherwise(F.lit(AXIS_NAMES[0]))
    return cm.select(F.concat(F.lit("Actual: "), name("actual")).alias("actual_label"),
                     F.concat(F.lit("Predicted: "), name("predicted")).alias("predicted_label"), "n")


def confusion_long_sql(cm_sql: str) -> str:
    return (f"SELECT 'Actual: ' || CASE WHEN actual = 1 THEN 'Yes' ELSE 'No' END AS actual_label, "
            f"'Predicted: ' || CASE WHEN predicted = 1 THEN 'Yes' ELSE 'No' END AS predicted_label, n FROM ({cm_sql})")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class, half-even at 4 dp; 0 when undefined."""
    c = pred.agg(
        F.count_if((F.col(label) == 1) & (F.col(prediction) == 1)).alias("tp"),
        F.count_if((F.col(label) != 1) & (F.col(prediction) == 1)).alias("fp"),
        F.count_if((F.col(label) == 1) & (F.col(prediction) != 1)).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))

    def ratio(num, den):
        return F.when(F.expr(den) == 0, F.lit(0.0)).otherwise(half_even_ratio(num, den, 4))
    return c.select(
        ratio("tp + tn", "n").alias("accuracy"),
        ratio("tp", "tp + fp").alias("precision"),
        ratio("tp", "tp + fn").alias("recall"),
        ratio("2 * tp", "2 * tp + fp + fn").alias("f1"),
    )


def classification_metrics_sql(pred_sql: str, label: str = "label", prediction: str = "prediction") -> str:
    def ratio(num, den):
        return f"CASE WHEN {den} = 0 THEN 0.0 ELSE {half_even_ratio_sql(num, den, 4)} END"
    return f"""
WITH c0 AS (SELECT COUNT(*) FILTER (WHERE {label} = 1 AND {prediction} = 1) AS tp,
                   COUNT(*) FILTER (WHERE {label} <> 1 AND {prediction} = 1) AS fp,
                   COUNT(*) FILTER (WHERE {label} = 1 AND {prediction} <> 1) AS fn,
                   COUNT(*) AS n FROM ({pred_sql})),
c AS (SELECT *, n - tp - fp - fn AS tn FROM c0)
SELECT {ratio('tp + tn', 'n')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision,
       {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c"""


def best_by(df: DataFrame, metric: str, tie_cols: list) -> DataFrame:
    """The row with the highest ``metric``; ties go to the first in ``tie_cols`` order.
    ``df`` is a results table (one row per k or per model), so one ordered pass is tiny."""
    return df.orderBy(F.desc(metric), *tie_cols).limit(1)
