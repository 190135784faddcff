"""Training: K-Means segmentation and the purchase classifiers.

K-Means, logistic regression and boosting fit many models in one pass over a blocked table
(``kmeans``, ``logistic``, ``boosting``); the random forest is Spark ML's.  The driver holds models
(centres, trees, coefficients) whose size does not grow with the data.  Metrics reuse the DataFrame
evaluation operators (``operators.evaluation``).  ``training`` keeps the same steps as artifacts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens import constants as K
from custlens.functions.materialize import materialize
from custlens.operators import evaluation as E
from custlens.operators import labels as L
from custlens.operators import predicates as P
from custlens.operators import segments as G
from custlens.plans import boosting, kmeans, logistic, silhouette
from custlens.plans.blocks import pack
from custlens.plans.fitted import PipelineClassifier


# ---------------------------------------------------------------- segmentation (H2, H3, H7)

def standardized(rfm: DataFrame, scaler: dict | None = None) -> tuple[DataFrame, dict]:
    """Cleaned (B2), standardized (H1, population std) features per customer, and the
    scaler (14 numbers) so new customers can be scored with the same scaling."""
    clean = P.clean_features(rfm.select("customer_id", *K.FEATURES))
    scaler = scaler or G.fit_scaler(clean)
    return G.standardize(clean, scaler), scaler


def k_search(z: DataFrame, k_range: tuple[int, int] = K.K_RANGE, starts: int = K.KMEANS_STARTS, seed: int = K.SEED,
             max_iter: int = 300) -> dict[int, tuple[kmeans.KMeansFit, dict]]:
    """H2, H3: per k the best of ``starts`` k-means++ runs (lowest within-cluster sum of squares) and
    its silhouettes: Euclidean with its error bound, and squared Euclidean (exact); all in the same passes."""
    blocks = pack(z, "customer_id", G.Z, name="kmeans-blocks")
    ks = list(range(k_range[0], k_range[1] + 1))
    fits = kmeans.fit_all(blocks, len(G.Z), ks, [seed + s for s in range(starts)], max_iter)
    best = [kmeans.best_of([f for f in fits if f.k == k]) for k in ks]
    squared = kmeans.squared_silhouettes(blocks, len(G.Z), best)
    plain = silhouette.euclidean(blocks, z, G.Z, [f.centres for f in best])
    return {f.k: (f, {"silhouette": s, "silhouette_error": e, "silhouette_squared": q}) for f, (s, e), q in zip(best, plain, squared)}


def search_table(spark: SparkSession, found: dict[int, tuple[kmeans.KMeansFit, dict]]) -> DataFrame:
    rows = [(k, f.inertia, s["silhouette"], s["silhouette_error"], s["silhouette_squared"]) for k, (f, s) in found.items()]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, silhouette_error double, silhouette_squared double")


def best_k(search: DataFrame) -> DataFrame:
    """Highest silhouette, smallest k on ties."""
    return E.best_by(search, "silhouette", [F.asc("k")])


@dataclass
class Segmentation:
    k: int
    kmeans: kmeans.KMeansFit
    search: DataFrame
    mapping: DataFrame
    named: DataFrame
    silhouette: float
    inertia: float
    scaler: dict
    extras: dict = field(default_factory=dict)


def segmentation_of(z: DataFrame, scaler: dict, found: dict[int, tuple[kmeans.KMeansFit, dict]],
                    keep: Callable[[DataFrame, str], DataFrame] = materialize) -> Segmentation:
    """H7 after the search: best k -> D19 scores -> E1 names -> labelled customers."""
    search = search_table(z.sparkSession, found)
    kbest = int(best_k(search).first()["k"])
    fit, sil = found[kbest][0], found[kbest][1]["silhouette"]
    assigned = keep(G.assign_segments(z, [(i, c.tolist()) for i, c in enumerate(fit.centres)]).select("customer_id", *K.FEATURES, "segment"), "segments")
    mapping = keep(G.segment_ranking(G.segment_scores(assigned), kbest), "mapping")
    return Segmentation(kbest, fit, search, mapping, G.name_segments(assigned, mapping), sil, fit.inertia, scaler)


def segmentation_run(rfm: DataFrame, k_range: tuple[int, int] = K.K_RANGE, starts: int = K.KMEANS_STARTS,
                     seed: int = K.SEED) -> Segmentation:
    """H7: scale -> k search -> best k -> D19 scores -> E1 names -> labelled customers."""
    z, scaler = standardized(rfm)
    z = materialize(z)
    return segmentation_of(z, scaler, k_search(z, k_range, starts, seed))


# ---------------------------------------------------------------- classifiers

#: What runs under each model name.
ALGORITHMS = {"RandomForest": "Spark RandomForestClassifier", "XGBoost": "second-order histogram boosting, depth 6",
              "LogisticRegression": "L2 logistic regression, Newton", "GradientBoosting": "first-order histogram boosting, depth 5"}
BOOSTED = {"XGBoost": (6, True), "GradientBoosting": (5, False)}
ROUNDS, RATE = 100, 0.1
#: Models that are fitted together, with their folds.
GROUPS = {"forest": ["RandomForest"], "logistic": ["LogisticRegression"], "boosted": list(BOOSTED)}


def classification_frame(named: DataFrame) -> DataFrame:
    """Customer features + segment, cleaned (B2), with the E3 label."""
    labels = L.purchase_target(named.select("customer_id", *K.FEATURES))
    base = named.select("customer_id", *K.FEATURES, F.col("segment").cast("double").alias("segment"))
    base = P.clean_features(base, K.CLASSIFIER_FEATURES)
    return base.join(labels.select("customer_id", F.col("will_purchase").cast("double").alias("label")), "customer_id")


def training_table(named: DataFrame, folds: int = K.CV_FOLDS, seed: int = K.SEED,
                   keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Every customer with inputs, label, ``is_test`` (E4) and, of the training part, ``fold`` (E5; -1: none)."""
    frame = classification_frame(named)
    split = L.stratified_split(frame.select("customer_id", F.col("label").cast("int").alias("will_purchase")), seed=seed)
    table = keep(frame.join(split.select("customer_id", "is_test"), "customer_id"), "split")
    if not folds:
        return table.withColumn("fold", F.lit(-1))
    fold = L.stratified_folds(table.where("not is_test").select("customer_id", F.col("label").cast("int").alias("will_purchase")), folds=folds, seed=seed)
    return keep(table.join(fold.select("customer_id", "fold"), "customer_id", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)).cast("int")), "training")


def _blocks(table: DataFrame) -> DataFrame:
    return pack(table.where("not is_test"), "customer_id", K.CLASSIFIER_FEATURES, ["label", "fold"], "training-blocks")


ROWS_PER_TASK = 50_000


def fit_forest(table: DataFrame, fold: int | None = None, seed: int = K.SEED) -> PipelineClassifier:
    """H8: 100 trees of depth 10, on the training part or what is outside a fold."""
    part = table.where("not is_test")
    part = part if fold is None else part.where(F.col("fold") != fold)
    part = part.coalesce(max(1, -(-part.count() // ROWS_PER_TASK)))
    stages = [VectorAssembler(inputCols=K.CLASSIFIER_FEATURES, outputCol="features", handleInvalid="keep"),
              RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, featuresCol="features", labelCol="label")]
    return PipelineClassifier(Pipeline(stages=stages).fit(part), K.CLASSIFIER_FEATURES)


def fit_group(group: str, table: DataFrame, folds: list[int | None], seed: int = K.SEED, names: list[str] | None = None,
              done: dict | None = None, progress: Callable[[dict], None] | None = None) -> dict[tuple[str, int | None], object]:
    """Models of a group, for all training rows (None) and without each fold."""
    names = names or GROUPS[group]
    if group == "forest":
        with ThreadPoolExecutor(len(folds)) as ex:
            return dict(zip([(names[0], f) for f in folds], ex.map(lambda f: fit_forest(table, f, seed), folds)))
    if group == "logistic":
        return {(names[0], f): m for f, m in zip(folds, logistic.fit_all(_blocks(table), K.CLASSIFIER_FEATURES, folds))}
    jobs = [(n, f) for n in names for f in folds]
    specs = [boosting.Spec(*BOOSTED[n], f) for n, f in jobs]
    models = boosting.fit_all(_blocks(table), table.where("not is_test"), K.CLASSIFIER_FEATURES, specs, ROUNDS, RATE, done, progress)
    return dict(zip(jobs, models))


def scored(model, rows: DataFrame) -> DataFrame:
    """Label, probability and decision of every row."""
    out = model.score(rows.select("customer_id", "label", *K.CLASSIFIER_FEATURES))
    return out.select("customer_id", F.col("label").cast("int").alias("label"), "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


def evaluate(scored_rows: DataFrame) -> dict:
    m = E.classification_metrics(scored_rows).first().asDict()
    m["auc"] = E.auc(scored_rows).first()["auc"]
    cm = E.confusion_matrix(scored_rows).orderBy("actual", "predicted").collect()  # 4 cells
    m["confusion_matrix"] = [[cm[0]["n"], cm[1]["n"]], [cm[2]["n"], cm[3]["n"]]]
    return m


def fold_auc(model, table: DataFrame, fold: int) -> float | None:
    """AUC on the rows that the model has not seen; null without both classes."""
    return E.auc(scored(model, table.where((F.col("fold") == fold) & ~F.col("is_test")))).first()["auc"]


def mean_and_std(aucs: list[float | None]) -> tuple[float | None, float | None]:
    known = [a for a in aucs if a is not None]  # a fold with one class has none
    if not known:
        return None, None
    mean = sum(known) / len(known)
    return mean, (sum((a - mean) ** 2 for a in known) / len(known)) ** 0.5


@dataclass
class TrainedModel:
    name: str
    model: object
    metrics: dict
    train_seconds: float
    cv_mean: float | None = None
    cv_std: float | None = None


def metrics_row(tm: TrainedModel) -> tuple:
    m = tm.metrics
    return (tm.name, ALGORITHMS[tm.name], m["accuracy"], m["precision"], m["recall"], m["f1"], m["auc"],
            tm.cv_mean, tm.cv_std, round(tm.train_seconds, 2))


METRICS_SCHEMA = ("model string, algorithm string, accuracy double, precision double, recall double, f1 double, auc double, "
                  "cv_auc_mean double, cv_auc_std double, train_time_seconds double")


def best_model(metrics: DataFrame) -> DataFrame:
    """Highest AUC; ties go to the earlier model in list order."""
    order = F.array_position(F.array(*[F.lit(n) for n in K.MODEL_NAMES]), F.col("model"))
    return E.best_by(metrics.withColumn("_pos", order), "auc", [F.asc("_pos")]).drop("_pos")


def importance(tm: TrainedModel) -> list[tuple[str, float]]:
    """H15 (trees: normalised gain per feature) or H16 (|coefficient| / sum |coefficient|)."""
    return tm.model.importance()


def is_linear(tm: TrainedModel) -> bool:
    return isinstance(tm.model, logistic.LogisticModel)


def importance_ranked(spark: SparkSession, tm: TrainedModel) -> DataFrame:
    """features by importance, descending, 4 dp."""
    rows = [(tm.name.lower(), f, float(v)) for f, v in importance(tm)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    return df.select("model", "feature", F.round("importance", 4).alias("importance")).orderBy(F.desc("importance"), "feature")


@dataclass
class ClassificationRun:
    models: dict[str, TrainedModel]
    metrics: DataFrame
    best: str
    target_distribution: DataFrame
    train_size: int
    test_size: int


def run_of(spark: SparkSession, models: dict[str, TrainedModel], table: DataFrame) -> ClassificationRun:
    metrics = spark.createDataFrame([metrics_row(tm) for tm in models.values()], METRICS_SCHEMA)
    sizes = table.agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")).first()
    td = L.target_distribution(table.select(F.col("label").cast("int").alias("will_purchase")))
    return ClassificationRun(models, metrics, best_model(metrics).first()["model"], td, sizes["train"], sizes["test"])


def classification_run(named: DataFrame, names: list[str] = K.MODEL_NAMES, cv_folds: int = K.CV_FOLDS, seed: int = K.SEED,
                       apart: bool = False) -> ClassificationRun:
    """Split -> (scale) -> fit each model -> metrics and CV -> best model by AUC.  ``apart`` fits
    one model at a time, so that each has its own time; otherwise a group's time counts for each of its models."""
    table = training_table(named, cv_folds, seed)
    test = table.where("is_test")
    folds = [None, *range(cv_folds)]
    parts = [(g, [n]) for g, all_ in GROUPS.items() for n in all_ if n in names] if apart else \
        [(g, mine) for g, all_ in GROUPS.items() if (mine := [n for n in all_ if n in names])]

    def fitted(part):
        t0 = time.time()
        models = fit_group(part[0], table, folds, seed, part[1])
        tests = {n: materialize(scored(models[n, None], test), "scored") for n in part[1]}
        seconds = time.time() - t0  # fit + predict, as the reference times it
        out = {}
        for n in part[1]:
            metrics = evaluate(tests[n])
            metrics["roc"] = E.roc_curve(tests[n]).orderBy("order_key")  # one row per distinct score; not collected
            with ThreadPoolExecutor(max(1, cv_folds)) as ex:
                aucs = list(ex.map(lambda f: fold_auc(models[n, f], table, f), range(cv_folds)))
            out[n] = TrainedModel(n, models[n, None], metrics, seconds, *mean_and_std(aucs))
        return out

    with ThreadPoolExecutor(1 if apart else len(parts)) as ex:
        models = {n: tm for part in ex.map(fitted, parts) for n, tm in part.items()}
    return run_of(table.sparkSession, {n: models[n] for n in names}, table)


# ---------------------------------------------------------------- scoring

def score_customers(customers: DataFrame, seg: Segmentation, model: TrainedModel, model_label: str,
                    keep: list[str] | None = None) -> DataFrame:
    """Table of customers -> segment, confidence, will_purchase, probability, model_used,
    recommendation.  Segment assignment applies the K-Means centres as literal expressions;
    a single request is a one-row table through the same plan."""
    keep = keep or ["customer_id"]
    feats = P.default_features_scoring(customers.select(*keep, *K.FEATURES))
    z = G.standardize(feats, seg.scaler)
    assigned = G.assign_segments(z, kmeans_centres(seg))
    named = P.segment_name_lookup(assigned, seg.mapping, fallback=True)
    rows = model.model.score(named.withColumn("segment", F.col("segment").cast("double")), "_probability")
    will, p4 = P.purchase_decision(F.col("_probability"))
    return rows.select(
        *keep,
        F.col("segment").cast("int").alias("segment_id"), "segment_name", "confidence",
        will.alias("will_purchase"), p4.alias("probability"), F.lit(model_label).alias("model_used"),
        P.recommendation_for("segment_name").alias("recommendation"))


class UnknownModel(ValueError):
    """A request names a model that is not loaded."""


def choose_model(models: dict[str, TrainedModel], best: str | None, requested: str | None) -> TrainedModel:
    """The requested model by its normalised name (B6); without a request the best one, else the
    first that is loaded."""
    loaded = {name.lower().replace(" ", ""): tm for name, tm in models.items()}
    if requested is not None and requested.strip():
        key = requested.lower().replace(" ", "")
        if key not in loaded:
            raise UnknownModel(f"Model {requested} not found")
        return loaded[key]
    return loaded.get((best or "").lower().replace(" ", "")) or next(iter(loaded.values()))


def score_requests(requests: DataFrame, seg: Segmentation, models: dict[str, TrainedModel], best: str | None,
                   validate: list[str] = K.FEATURES) -> DataFrame:
    """Scoring requests (feature values as text, optional ``model_name``) -> one row each: the H19
    result, or ``error`` for a request that fails validation (B4) or names an unknown model."""
    checks = P.validate_requests(requests, validate).select("customer_id", F.col("reason").alias("invalid"))
    rows = requests.join(checks, "customer_id").withColumn("model_key", P.normalize_model_name("model_name"))
    default = choose_model(models, best, None).name.lower().replace(" ", "")
    rows = rows.withColumn("model_key", F.when(F.col("model_key") == "", default).otherwise(F.col("model_key")))
    known = {name.lower().replace(" ", ""): tm for name, tm in models.items()}
    rows = rows.withColumn("error", F.coalesce("invalid", F.when(~F.col("model_key").isin(*known), F.concat(F.lit("Model "), "model_name", F.lit(" not found")))))
    rows = materialize(rows, "score-requests")
    out = rows.where("error is not null").select("customer_id", "model_key", "error")
    for key, tm in known.items():   # a handful of models, each applied to its own requests
        mine = rows.where(F.col("error").isNull() & (F.col("model_key") == key))
        mine = mine.select("customer_id", "model_key", *[F.col(c).try_cast("double").alias(c) for c in K.FEATURES])
        scored = score_customers(mine, seg, tm, tm.name, keep=["customer_id", "model_key"])
        out = out.unionByName(scored, allowMissingColumns=True)
    return out


def kmeans_centres(seg: Segmentation) -> list[tuple[int, list[float]]]:
    return [(i, [float(x) for x in c]) for i, c in enumerate(seg.kmeans.centres)]
