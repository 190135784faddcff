"""Registered queries: K-Means, classifiers, importances, scoring, model and metric stores
(A9, A10, E8, E9, F5, G5, G6, H2, H3, H7-H11, H14-H20).

They return what was fitted.  SQL can't state that, so they have no oracle; what must hold of the values
(sizes, sums, orders, choices) is tested in ``tests/test_fitted.py``.  A key builds only the artifacts
that it returns (``training``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlens import constants as K
from custlens.functions.ranking import ordered_prefix_sums
from custlens.operators import predicates as P
from custlens.operators import rfm
from custlens.operators import segments as G
from custlens.plans import models as M
from custlens.plans.registry import register
from custlens.plans.training import training
from custlens.session import scratch_path
from custlens.sources import stores
from custlens.sources import tables as S

RFM = rfm.rfm_sql(S.HISTORY_SQL)
METRICS = ["accuracy", "precision", "recall", "f1", "auc"]


# ---------------------------------------------------------------- segmentation

@register("kmeans_fit")
def q_kmeans_fit(spark, sf_dir):
    """H2: the centres of the best start for the chosen k, and its cost."""
    run = training(spark, sf_dir)
    k = M.best_k(run.search).first()["k"]
    fit = run.kmeans(k)
    rows = [(i, *c, fit.inertia) for i, c in enumerate(fit.centres.tolist())]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{z} double" for z in G.Z) + ", inertia double")


@register("k_search")
def q_k_search(spark, sf_dir):
    return training(spark, sf_dir).search


@register("best_k")
def q_best_k(spark, sf_dir):
    """E8 on the fitted search."""
    return M.best_k(training(spark, sf_dir).search)


@register("segmentation_run")
def q_segmentation_run(spark, sf_dir):
    return training(spark, sf_dir).seg.named.select("customer_id", "segment", "segment_name")


# ---------------------------------------------------------------- classifiers

def _metrics(spark, models):
    return spark.createDataFrame([M.metrics_row(tm) for tm in models], M.METRICS_SCHEMA)


def _trained(name):
    """The model's test metrics and its time; cross-validation has its own key."""
    return lambda spark, sf_dir: _metrics(spark, [training(spark, sf_dir).model(name)]).drop("cv_auc_mean", "cv_auc_std")


@register("cross_validate_auc")
def q_cross_validate_auc(spark, sf_dir):
    return training(spark, sf_dir).cls.metrics.select("model", "cv_auc_mean", "cv_auc_std")


def _importance(linear):
    def q(spark, sf_dir):
        run = training(spark, sf_dir)
        names = [n for n in run.names if (n == "LogisticRegression") == linear]
        rows = [(n, f, v) for n in names for f, v in M.importance(run.model(n))]
        return spark.createDataFrame(rows, "model string, feature string, importance double")
    return q


register("train_logistic")(_trained("LogisticRegression"))
register("linear_importance")(_importance(True))
register("train_random_forest")(_trained("RandomForest"))
register("train_boosted_d6")(_trained("XGBoost"))
register("train_boosted_d5")(_trained("GradientBoosting"))
register("tree_importance")(_importance(False))


@register("importance_ranked")
def q_importance_ranked(spark, sf_dir):
    """F5 for every model by name."""
    run, out = training(spark, sf_dir), None
    for n in run.names:
        ranked = M.importance_ranked(spark, run.model(n))
        out = ranked if out is None else out.unionByName(ranked)
    return out


@register("classification_run")
def q_classification_run(spark, sf_dir):
    return training(spark, sf_dir).cls.metrics


@register("best_model")
def q_best_model(spark, sf_dir):
    """E9 on the fitted models' metrics."""
    return M.best_model(training(spark, sf_dir).tested.metrics).drop("cv_auc_mean", "cv_auc_std")


@register("model_metric_long")
def q_model_metric_long(spark, sf_dir):
    """G5 on the fitted models' metrics."""
    m = training(spark, sf_dir).tested.metrics
    return m.select("model", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value"))
                                                 for n in METRICS])).alias("s")).select("model", "s.*")


@register("training_run")
def q_training_run(spark, sf_dir):
    run = training(spark, sf_dir)
    seg, cls = run.seg, run.cls
    td = {int(r["will_purchase"]): int(r["customers"]) for r in cls.target_distribution.collect()}  # 2 rows
    row = (seg.k, round(seg.silhouette, 4), cls.best, cls.train_size, cls.test_size, td.get(0, 0), td.get(1, 0))
    return spark.createDataFrame([row], "k_optimal int, silhouette_score double, best_model string, train_size long, test_size long, target_0 long, target_1 long")


# ---------------------------------------------------------------- scoring

@register("score_customers")
def q_score_customers(spark, sf_dir):
    """H19 with the default model, every customer."""
    run = training(spark, sf_dir)
    best = M.choose_model(run.tested.models, run.tested.best, None)
    return M.score_customers(run.features, run.seg, best, best.name)


_ASKED = "SELECT customer_id, {f}, CASE WHEN customer_id % 7 = 3 THEN 'No Such Model' ELSE model_name END AS model_name".format(
    f=", ".join(f"CASE WHEN customer_id % 11 = {i} THEN 'bad' ELSE {c} END AS {c}" for i, c in enumerate(K.FEATURES)))
_KEY = P.normalize_model_name_sql("model_name")
_KNOWN = ", ".join(f"'{n.lower()}'" for n in K.MODEL_NAMES)


@register("score_requests", f"""WITH q AS ({_ASKED} FROM ({P.scoring_requests_sql(RFM)})),
    v AS ({P.validate_requests_sql('SELECT * FROM q')})
    SELECT q.customer_id, {_KEY} AS asked,
           COALESCE(v.reason, CASE WHEN {_KEY} NOT IN ('', {_KNOWN}) THEN 'Model ' || model_name || ' not found' END) AS error,
           v.reason IS NULL AND {_KEY} IN ('', {_KNOWN}) AS scored
    FROM q JOIN v USING (customer_id)""")
def q_score_requests(spark, sf_dir):
    """H19 by requested model: named ones, the default, unknown names and invalid requests."""
    run = training(spark, sf_dir)
    asked = P.scoring_requests(run.features).selectExpr("customer_id", *[f"CASE WHEN customer_id % 11 = {i} THEN 'bad' ELSE {c} END AS {c}" for i, c in enumerate(K.FEATURES)],
                                             "CASE WHEN customer_id % 7 = 3 THEN 'No Such Model' ELSE model_name END AS model_name")
    out = M.score_requests(asked, run.seg, run.tested.models, run.tested.best)
    names = asked.select("customer_id", P.normalize_model_name("model_name").alias("asked"))
    used = F.lower(F.col("model_used")) == F.col("model_key")
    return out.join(names, "customer_id").select("customer_id", "asked", "error", F.coalesce(used & F.col("probability").between(0.0, 1.0), F.lit(False)).alias("scored"))


@register("model_inventory")
def q_model_inventory(spark, sf_dir):
    run = training(spark, sf_dir)
    names = [r["segment_name"] for r in run.seg.mapping.orderBy("rank").collect()]  # at most 10 rows
    row = (",".join(n.lower() for n in run.tested.models), run.tested.best, ",".join(K.CLASSIFIER_FEATURES), ",".join(names))
    return spark.createDataFrame([row], "models_available string, best_model string, feature_columns string, segments string")


@register("roc_points")
def q_roc_points(spark, sf_dir):
    """Every fitted model's curve by the points' places in it, and the diagonal."""
    return _roc_points(spark, {n: tm.metrics["roc"] for n, tm in training(spark, sf_dir).tested.models.items()})


def _roc_points(spark, curves):
    out = spark.createDataFrame([("Random", 0, 0.0, 0.0), ("Random", 1, 1.0, 1.0)], "model string, i long, fpr double, tpr double")
    for name, roc in curves.items():
        placed = ordered_prefix_sums(roc.select(F.col("order_key"), "fpr", "tpr", F.lit(1).cast("long").alias("one")), "order_key", ["one"], descending=False, inclusive=False)
        out = out.unionByName(placed.select(F.lit(name).alias("model"), F.col("cum_one").alias("i"), "fpr", "tpr"))
    return out


# ---------------------------------------------------------------- stores

@register("metrics_store")
def q_metrics_store(spark, sf_dir):
    """The whole results document, written and read back."""
    run = training(spark, sf_dir)
    return stores.read_metrics(spark, stores.write_metrics(stores.results_document(spark, run.seg, run.cls), scratch_path(spark, "results")))


@register("model_store")
def q_model_store(spark, sf_dir):
    """A10: the models saved and loaded; one more whose file is damaged is skipped, and if it is the best
    one, the first that loads is the default."""
    run = training(spark, sf_dir)
    paths = stores.save_models(spark, {n: tm.model for n, tm in run.tested.models.items()}, scratch_path(spark, "models"))
    first = next(iter(run.tested.models.values()))
    broken = stores.save_models(spark, {"Damaged": first.model}, scratch_path(spark, "models"))["damaged"]
    spark.createDataFrame([("{",)], "value string").coalesce(1).write.mode("overwrite").text(f"{broken}/model")
    paths = {"damaged": broken, **paths}
    loaded, default = stores.load_models(spark, paths, run.tested.best)
    _, without = stores.load_models(spark, paths, "Damaged")
    return spark.createDataFrame([(k, k in loaded, k == default, k == without) for k in paths],
                                 "model string, loaded boolean, is_default boolean, is_default_without_best boolean")
