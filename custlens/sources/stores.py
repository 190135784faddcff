"""Training results and model artifacts.

Metrics are written as JSON lines and read back with an explicit schema; models are folders
(``plans.fitted``), loaded one by one so a damaged artifact is skipped."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


log = logging.getLogger(__name__)

DOCUMENT_DDL = "section string, model string, key string, position long, value double, text string"


def results_document(spark: SparkSession, seg, cls) -> DataFrame:
    """Everything a training run reports, one row per value: metrics, cross-validation,
    confusion cells, ROC points and importances of each model; inertia and silhouette of each k;
    the segment mapping and distribution; sizes and the best model.  Only the ROC points grow
    with the data (one per distinct score); they stay a distributed frame."""
    from custlens.plans.models import importance
    rows = []

    def put(section, model, key, value=None, text=None, position=0):
        rows.append((section, model, key, position, None if value is None else float(value), text))

    for name, tm in cls.models.items():
        for key in ("accuracy", "precision", "recall", "f1", "auc"):
            put("metrics", name, key, tm.metrics[key])
        put("metrics", name, "cv_auc_mean", tm.cv_mean)
        put("metrics", name, "cv_auc_std", tm.cv_std)
        put("metrics", name, "train_time_seconds", tm.train_seconds)
        for i, actual in enumerate(tm.metrics["confusion_matrix"]):
            for j, n in enumerate(actual):
                put("confusion", name, f"{i},{j}", n)
        for i, (feature, v) in enumerate(importance(tm)):
            put("importance", name, feature, v, position=i)
    for r in seg.search.collect():  # a row per k
        put("k_search", "KMeans", f"inertia {r['k']}", r["inertia"], position=r["k"])
        put("k_search", "KMeans", f"silhouette {r['k']}", r["silhouette"], position=r["k"])
    for r in seg.mapping.collect():  # a row per segment
        put("mapping", "KMeans", str(r["segment"]), text=r["segment_name"], position=r["rank"])
    for r in seg.named.groupBy("segment_name").count().collect():  # a row per segment
        put("distribution", "KMeans", r["segment_name"], r["count"])
    for key, value in (("k", seg.k), ("silhouette", seg.silhouette), ("inertia", seg.inertia), ("train_size", cls.train_size), ("test_size", cls.test_size)):
        put("metadata", "run", key, value)
    put("metadata", "run", "best_model", text=cls.best)
    out = spark.createDataFrame(rows, DOCUMENT_DDL)
    for name, tm in cls.models.items():
        points = tm.metrics["roc"].select(F.explode(F.array(F.struct(F.lit("fpr").alias("key"), F.col("fpr").alias("value")),
                                                            F.struct(F.lit("tpr").alias("key"), F.col("tpr").alias("value")))).alias("p"), F.col("order_key").alias("position"))
        out = out.unionByName(points.select(F.lit("roc").alias("section"), F.lit(name).alias("model"), "p.key", "position", "p.value", F.lit(None).cast("string").alias("text")))
    return out


def write_metrics(df: DataFrame, path: str) -> str:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def read_metrics(spark: SparkSession, path: str, ddl: str = DOCUMENT_DDL) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def save_models(spark: SparkSession, models: dict[str, object], base: str) -> dict[str, str]:
    """A10 (save): one directory per model, keyed by the normalized model name."""
    out = {}
    for name, m in models.items():
        key = name.lower().replace(" ", "")
        out[key] = f"{base.rstrip('/')}/{key}"
        m.save(spark, out[key])
    return out


def load_models(spark: SparkSession, paths: dict[str, str], best: str | None) -> tuple[dict[str, object], str | None]:
    """A10 (load): every loadable model; a failing one is skipped with a message.  Default is the
    best model if it loaded, else the first loaded one."""
    from custlens.plans.fitted import load
    loaded = {}
    for key, path in paths.items():
        try:
            loaded[key] = load(spark, path)
        except Exception as e:  # one bad artifact must not block the others
            log.warning("skipping model %s: %s", key, e)
    best_key = (best or "").lower().replace(" ", "")
    default = best_key if best_key in loaded else next(iter(loaded), None)
    return loaded, default
