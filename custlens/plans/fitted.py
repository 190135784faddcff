"""Fitted classifiers: small models that score a table, name their importances, and are saved.

Each has ``score`` (adds a column with the probability of class 1), ``importance`` (normalised, in the
order of its features), ``save`` and a kind by which ``load`` finds its class.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _normalised(v) -> list[float]:
    total = float(sum(v))
    return [float(x) / total if total else 0.0 for x in v]


class _Json:
    """Models that are a few numbers: one JSON line."""

    def save(self, spark: SparkSession, path: str) -> None:
        line = json.dumps({"kind": self.kind, **self.values()})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


class LogisticModel(_Json):
    kind = "logistic"

    def __init__(self, features, mean, scale, coefficients, intercept):
        self.features, self.mean, self.scale, self.coefficients, self.intercept = features, mean, scale, coefficients, intercept

    def values(self):
        return {k: getattr(self, k) for k in ("features", "mean", "scale", "coefficients", "intercept")}

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        margin = F.lit(float(self.intercept))
        for c, m, s, w in zip(self.features, self.mean, self.scale, self.coefficients):
            margin = margin + (F.col(c).cast("double") - F.lit(m)) / F.lit(s) * F.lit(w)
        return df.withColumn(out, 1.0 / (1.0 + F.exp(-margin)))

    def importance(self):
        return list(zip(self.features, _normalised([abs(c) for c in self.coefficients])))


class BoostedModel(_Json):
    """Trees as heaps: the children of node i are 2 i + 1 (bin <= ``cut``) and 2 i + 2; a node with
    feature -1 is a leaf."""

    kind = "boosted"

    def __init__(self, features, edges, start, trees, gains):
        self.features, self.edges, self.start, self.trees, self.gains = features, edges, start, trees, gains

    def values(self):
        return {k: getattr(self, k) for k in ("features", "edges", "start", "trees", "gains")}

    def importance(self):
        return list(zip(self.features, _normalised(self.gains)))

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        features, edges, start, trees = self.features, self.edges, self.start, self.trees

        def scored(batches):
            for b in batches:
                x = np.stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1) if b.num_rows else np.zeros((0, len(features)))
                margin = margins(binned(x, edges), start, trees)
                keep = [b.column(c) for c in b.schema.names[:-len(features)]]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(1.0 / (1.0 + np.exp(-margin)))], names=[*b.schema.names[:-len(features)], out])

        inputs = df.select("*", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
        return inputs.mapInArrow(scored, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of every value: the number of edges below it."""
    return np.stack([np.searchsorted(np.asarray(e, dtype=np.float64), x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if x.size else np.zeros(x.shape, dtype=np.uint8)


def leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    at = np.zeros(len(bins), dtype=np.int64)
    flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    inner = feature >= 0
    feature, cut = np.maximum(feature, 0), np.where(inner, cut, 255).astype(np.uint8)   # no bin is above 255: a row stays in a leaf
    child = np.where(inner, 2 * np.arange(len(feature)) + 1, np.arange(len(feature)))
    for _ in range(depth):
        goes = flat.take(first + feature.take(at)) > cut.take(at)
        at = child.take(at)
        at += goes
    return at


def margins(bins: np.ndarray, start: float, trees: list[dict]) -> np.ndarray:
    out = np.full(len(bins), start)
    for t in trees:
        feature, cut, value = np.asarray(t["feature"]), np.asarray(t["cut"]), np.asarray(t["value"])
        out += value[leaf_of(bins, feature, cut, int(np.log2(len(feature) + 1)) - 1)]
    return out


class PipelineClassifier:
    """A Spark ML pipeline with a probability column."""

    kind = "pipeline"

    def __init__(self, pipeline: PipelineModel, features: list[str]):
        self.pipeline, self.features = pipeline, features

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        scored = self.pipeline.transform(df)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))

    def importance(self):
        return list(zip(self.features, [float(v) for v in self.pipeline.stages[-1].featureImportances.toArray()]))

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        line = json.dumps({"kind": self.kind, "features": self.features})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load(spark: SparkSession, path: str):
    v = json.loads(spark.read.text(f"{path}/model").first()["value"])
    kind = v.pop("kind")
    if kind == PipelineClassifier.kind:
        return PipelineClassifier(PipelineModel.load(f"{path}/pipeline"), v["features"])
    return {c.kind: c for c in (LogisticModel, BoostedModel)}[kind](**v)
