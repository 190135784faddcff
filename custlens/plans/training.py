"""The training run as a graph of artifacts, each built once and shared by all sessions.

features -> scaler and k search -> segmentation -> training table -> models and folds.  A query builds
only what it returns: ``kmeans_fit`` fits no classifier, ``train_logistic`` no trees.  Artifacts lie under
the shared checkpoint folder (``sources.artifacts``), keyed by the source files, the settings and the code
that shapes them; a session that is ended leaves its finished ones, and the boosted models' trees so
far, to the next.  Registered settings: reference hyperparameters throughout, 5-fold
cross-validation of every model.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from custlens import constants as K
from custlens.operators import evaluation, labels, predicates, rfm, segments
from custlens.plans import blocks, boosting, fitted, kmeans, logistic, silhouette
from custlens.plans import models as M
from custlens.session import ensure_checkpoint_dir
from custlens.sources import feature_store as FS
from custlens.sources.artifacts import Artifacts

SETTINGS = {"k_range": K.K_RANGE, "starts": K.KMEANS_STARTS, "seed": K.SEED, "cv_folds": K.CV_FOLDS}
#: Modules that shape an artifact, beyond those of what it is made from.
SHAPED_BY = {"features": [rfm], "search": [predicates, segments, blocks, kmeans, silhouette], "segments": [], "table": [labels],
             "forest": [fitted], "logistic": [logistic, fitted], "boosted": [boosting, logistic, fitted], "metrics": [evaluation]}

_LOCK = threading.Lock()
_RUNS: dict = {}


def _code(*names: str) -> str:
    sources = [inspect.getsource(m) for n in names for m in SHAPED_BY[n]] + [inspect.getsource(M)]
    return hashlib.sha256("\n".join(sources).encode()).hexdigest()[:16]


def _label(name: str, fold: int | None) -> str:
    return name if fold is None else f"{name}-{fold}"


class Run:
    """One data snapshot's artifacts, read or built when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: dict = SETTINGS, names: list[str] = K.MODEL_NAMES):
        self.spark, self.sf_dir, self.settings, self.names = spark, sf_dir, settings, names
        self.store = Artifacts(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/training")
        self._source = [sf_dir, FS._signature(spark, sf_dir, FS.SOURCES["history"])]
        self._guard = threading.RLock()

    def _key(self, *steps: str, **more) -> list:
        return [self._source, self.settings, _code(*steps), more]

    def _parquet(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def _write_json(self, value: object, path: str) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _read_json(self, path: str):
        return json.loads(self.spark.read.text(path).first()["value"])

    # -- customers

    @cached_property
    def features(self) -> DataFrame:
        path = self.store.get("features", self._key("features"), lambda p: self._parquet(FS.rfm_features(self.spark, self.sf_dir, "history"), p))
        return self.spark.read.parquet(path)

    @cached_property
    def _search(self) -> tuple[dict, dict[int, tuple[kmeans.KMeansFit, dict]]]:
        def build(path):
            z, scaler = M.standardized(self.features)
            found = M.k_search(z, tuple(self.settings["k_range"]), self.settings["starts"], self.settings["seed"])
            fits = [{"k": k, "seed": f.seed, "centres": f.centres.tolist(), "inertia": f.inertia, "iterations": f.iterations, "silhouettes": s} for k, (f, s) in found.items()]
            self._write_json({"scaler": scaler, "fits": fits}, path)

        v = self._read_json(self.store.get("search", self._key("features", "search"), build))
        found = {f["k"]: (kmeans.KMeansFit(f["k"], f["seed"], np.array(f["centres"]), f["inertia"], f["iterations"]), f["silhouettes"]) for f in v["fits"]}
        return {c: tuple(x) for c, x in v["scaler"].items()}, found

    @cached_property
    def search(self) -> DataFrame:
        return M.search_table(self.spark, self._search[1])

    def kmeans(self, k: int) -> kmeans.KMeansFit:
        return self._search[1][k][0]

    @cached_property
    def seg(self) -> M.Segmentation:
        scaler, found = self._search

        def build(path):
            def keep(df, name):
                self._parquet(df, f"{path}/{name}")
                return self.spark.read.parquet(f"{path}/{name}")
            M.segmentation_of(M.standardized(self.features, scaler)[0], scaler, found, keep)

        path = self.store.get("segments", self._key("features", "search", "segments"), build)
        return M.segmentation_of(M.standardized(self.features, scaler)[0], scaler, found, lambda df, name: self.spark.read.parquet(f"{path}/{name}"))

    @cached_property
    def table(self) -> DataFrame:
        path = self.store.get("table", self._key("features", "search", "segments", "table"),
                              lambda p: self._parquet(M.training_table(self.seg.named, self.settings["cv_folds"], self.settings["seed"]), p))
        return self.spark.read.parquet(path)

    # -- classifiers

    def _model_key(self, group: str, name: str, fold: int | None) -> list:
        return self._key("features", "search", "segments", "table", group, "metrics", model=name, fold=fold, rounds=M.ROUNDS, rate=M.RATE)

    def _wanted(self, group: str, folds: list[int | None]) -> dict[str, list]:
        names = [n for n in M.GROUPS[group] if n in self.names]
        return {_label(n, f): self._model_key(group, n, f) for n in names for f in folds}

    def _published(self, group: str, folds: list[int | None]) -> bool:
        return all(self.store.find(self.store.folder(n, k)) for n, k in self._wanted(group, folds).items())

    def _fitted(self, group: str, folds: list[int | None]) -> dict[str, str]:
        """Paths of a group's models and evaluations, ``name`` or ``name-fold``; all fitted in the same passes."""
        names, label, wanted = [n for n in M.GROUPS[group] if n in self.names], _label, self._wanted(group, folds)

        def build(publish):
            table, notes = self.table, self.store.folder(f"{group}-progress", wanted)
            t0 = time.time()
            more = {"done": self.store.kept(notes), "progress": lambda v: self.store.keep(notes, len(v["trees"][0]), v)} if group == "boosted" else {}
            if group == "forest":   # independent fits: each is published when it is done
                def one(f):
                    start = time.time()
                    m = M.fit_forest(table, f, self.settings["seed"])
                    publish(label(names[0], f), lambda p: self._write_model(p, m, f, start))
                with ThreadPoolExecutor(len(folds)) as ex:
                    list(ex.map(one, folds))
                return
            models = M.fit_group(group, table, folds, self.settings["seed"], names, **more)
            with ThreadPoolExecutor(8) as ex:
                list(ex.map(lambda nf: publish(label(*nf), lambda p: self._write_model(p, models[nf], nf[1], t0)), models))

        return self.store.all_of(wanted, f"{group}-fit", build)

    def _write_model(self, path: str, model, fold: int | None, start: float) -> None:
        if fold is None:
            test = M.scored(model, self.table.where("is_test"))
            self._parquet(test, f"{path}/test")
            seconds = time.time() - start   # fit and predict; models of one group share their passes
            test = self.spark.read.parquet(f"{path}/test")
            self._parquet(evaluation.roc_curve(test), f"{path}/roc")
            self._write_json({**M.evaluate(test), "train_seconds": seconds}, f"{path}/metrics")
        else:
            self._write_json({"auc": M.fold_auc(model, self.table, fold)}, f"{path}/metrics")
        model.save(self.spark, f"{path}/model")

    def _group(self, name: str) -> str:
        return next(g for g, names in M.GROUPS.items() if name in names)

    def model(self, name: str) -> M.TrainedModel:
        """The model fitted on the whole training part, and its test metrics."""
        with self._guard:
            if name not in self._models:
                paths = self._fitted(self._group(name), [None])   # no folds: what reads the model alone asks for none
                v = self._read_json(f"{paths[name]}/metrics")
                seconds = v.pop("train_seconds")
                v["roc"] = self.spark.read.parquet(f"{paths[name]}/roc").orderBy("order_key")
                self._models[name] = M.TrainedModel(name, fitted.load(self.spark, f"{paths[name]}/model"), v, seconds)
            return self._models[name]

    @cached_property
    def _models(self) -> dict:
        return {}

    @property
    def _folds(self) -> list[int | None]:
        return [None, *range(self.settings["cv_folds"])]

    def cross_validated(self, name: str) -> M.TrainedModel:
        """The model with its folds' mean AUC and deviation.

        Boosted models and logistic regression get their folds in the passes of the whole fits, unless these are
        there already."""
        group = self._group(name)
        with self._guard:
            if group != "forest" and name not in self._models and not self._published(group, [None]):
                self._fitted(group, self._folds)
        tm = self.model(name)
        if tm.cv_mean is None:
            paths = self._fitted(group, self._folds[1:])
            aucs = [self._read_json(f"{paths[f'{name}-{f}']}/metrics")["auc"] for f in range(self.settings["cv_folds"])]
            tm.cv_mean, tm.cv_std = M.mean_and_std(aucs)
        return tm

    @cached_property
    def tested(self) -> M.ClassificationRun:
        """All models and their test metrics, without cross-validation where that takes further fits."""
        return M.run_of(self.spark, {n: self.model(n) for n in self.names}, self.table)

    @cached_property
    def cls(self) -> M.ClassificationRun:
        return M.run_of(self.spark, {n: self.cross_validated(n) for n in self.names}, self.table)


def training(spark: SparkSession, sf_dir: str) -> Run:
    """The run of this data snapshot; its parts are built when they are read."""
    key = (spark.sparkContext.applicationId, sf_dir, FS._signature(spark, sf_dir, FS.SOURCES["history"]), ensure_checkpoint_dir(spark))
    with _LOCK:
        if key not in _RUNS:
            _RUNS[key] = Run(spark, sf_dir)
        return _RUNS[key]
