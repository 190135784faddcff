"""What must hold of the fitted values that the model keys return, on a small training run."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens import constants as K
from custlens.operators import segments as G
from custlens.plans import boosting as B
from custlens.plans import kmeans as KM
from custlens.plans import models as M
from custlens.plans import q_models, q_streaming
from custlens.plans.blocks import pack
from custlens.plans.logistic import fit_all
from custlens.plans.registry import ORACLES, QUERIES
from custlens.plans.training import Run
from tests.conftest import SF_SMALL

SETTINGS = {"k_range": (3, 4), "starts": 2, "seed": 42, "cv_folds": 2}


@pytest.fixture(scope="module")
def run(spark):
    rounds, M.ROUNDS = M.ROUNDS, 7
    yield Run(spark, SF_SMALL, SETTINGS)
    M.ROUNDS = rounds


@pytest.fixture
def rows(spark, run, monkeypatch):
    monkeypatch.setattr(q_models, "training", lambda spark, sf_dir: run)
    monkeypatch.setattr(q_streaming, "training", lambda spark, sf_dir: run)

    def of(key):
        assert key not in ORACLES
        return [r.asDict() for r in QUERIES[key](spark, SF_SMALL).collect()]

    return of


def test_a_key_builds_only_what_it_returns(rows, run):
    assert len(rows("k_search")) == 2
    built = set(run.__dict__)
    assert "_search" in built and not built & {"seg", "table", "cls", "tested"}
    rows("train_logistic")
    assert set(run._models) == {"LogisticRegression"}


def test_another_session_reads_the_artifacts(spark, run, monkeypatch):
    run.model("LogisticRegression")
    again = Run(spark, SF_SMALL, SETTINGS)
    monkeypatch.setattr(M, "fit_group", lambda *a, **k: pytest.fail("fitted again"))
    monkeypatch.setattr(M, "k_search", lambda *a, **k: pytest.fail("searched again"))
    assert again.model("LogisticRegression").model.values() == run.model("LogisticRegression").model.values()
    assert again.seg.named.count() == run.features.count()


def test_an_ended_builder_leaves_its_rounds(spark, run, monkeypatch):
    folder, seen = run.store.folder("test-progress", uuid.uuid4().hex), []
    blocks = M._blocks(run.table)
    specs = [B.Spec(3, True), B.Spec(2, False, 1)]
    monkeypatch.setattr(B, "CUT_EVERY", 2)

    def note(v):
        run.store.keep(folder, len(v["trees"][0]), v)
        if len(v["trees"][0]) == 4:
            raise InterruptedError
    with pytest.raises(InterruptedError):
        B.fit_all(blocks, run.table, K.CLASSIFIER_FEATURES, specs, 6, 0.1, None, note)
    done = run.store.kept(folder)
    assert len(done["trees"][0]) == 4
    resumed = B.fit_all(blocks, run.table, K.CLASSIFIER_FEATURES, specs, 6, 0.1, done, seen.append)
    whole = B.fit_all(blocks, run.table, K.CLASSIFIER_FEATURES, specs, 6, 0.1)
    for a, b in zip(resumed, whole):
        assert [t["feature"] for t in a.trees] == [t["feature"] for t in b.trees]
        assert np.allclose([t["value"] for t in a.trees][-1], [t["value"] for t in b.trees][-1])


def test_folds_are_fitted_only_for_cross_validation(spark, run, monkeypatch):
    asked, fit = [], M.fit_group
    monkeypatch.setattr(M, "fit_group", lambda group, table, folds, *a, **k: asked.append((group, folds)) or fit(group, table, folds, *a, **k))
    monkeypatch.setattr(M, "ROUNDS", 2)
    own = {**SETTINGS, "of": uuid.uuid4().hex}   # artifacts that no other test has built
    alone = Run(spark, SF_SMALL, own)
    assert alone.model("XGBoost").cv_mean is None and asked == [("boosted", [None])]
    assert alone.cross_validated("XGBoost").cv_mean > 0.5 and asked[1:] == [("boosted", [0, 1])]
    first = {name: alone.model(name).model.trees for name in M.BOOSTED}
    monkeypatch.setattr(M, "ROUNDS", 3)
    together = Run(spark, SF_SMALL, own)   # asked for at once, they share their passes
    assert together.cross_validated("XGBoost").cv_mean > 0.5 and asked[2:] == [("boosted", [None, 0, 1])]
    together.cross_validated("GradientBoosting")
    assert len(asked) == 3
    for name in M.BOOSTED:   # the same trees in either company
        assert together.model(name).model.trees[:2] == first[name]


def test_a_stale_lease_is_free(spark, run):
    key = uuid.uuid4().hex   # the shared folder may outlive a session
    folder = run.store.folder("leased", key)
    run.store._write(f"{folder}/lease", "gone")
    fs, p = run.store._fs(f"{folder}/lease")
    fs.setTimes(p, 1000, -1)
    path = run.store.get("leased", key, lambda p: run.store._write(f"{p}/part", "whole"))
    assert run.store._text(f"{path}/part") == "whole" and not fs.exists(p)
    assert run.store.get("leased", key, lambda p: pytest.fail("built again")) == path


def test_choices_read_the_fitted_run(rows, run):
    search = {r["k"]: r["silhouette"] for r in run.search.collect()}
    assert [(r["k"], r["silhouette"]) for r in rows("best_k")] == [(run.seg.k, max(search.values()))]
    metrics = {r["model"]: r.asDict() for r in run.cls.metrics.collect()}
    assert [(r["model"], r["auc"]) for r in rows("best_model")] == [(run.cls.best, max(m["auc"] for m in metrics.values()))]
    long = {(r["model"], r["metric"]): r["value"] for r in rows("model_metric_long")}
    assert long == {(n, m): metrics[n][m] or 0.0 for n in metrics for m in q_models.METRICS}


def test_ties_and_nulls_in_choices(spark):
    search = spark.createDataFrame([(5, 0.5), (3, 0.5), (4, 0.25), (6, None)], "k int, silhouette double")
    assert M.best_k(search).first()["k"] == 3
    metrics = spark.createDataFrame([("GradientBoosting", 0.9), ("XGBoost", 0.9), ("RandomForest", None)], "model string, auc double")
    assert M.best_model(metrics).first()["model"] == "XGBoost"


def test_fitted_values_are_returned(rows, run):
    customers = run.features.count()
    centres = rows("kmeans_fit")
    assert len(centres) == run.seg.k and {c["inertia"] for c in centres} == {run.seg.inertia}
    z, _ = M.standardized(run.features, run.seg.scaler)
    cost = G.assign_segments(z, M.kmeans_centres(run.seg)).agg(F.sum(F.col("distance") ** 2)).first()[0]
    assert cost == pytest.approx(run.seg.inertia, rel=1e-9)
    segments = rows("segmentation_run")
    assert len(segments) == customers and {s["segment_name"] for s in segments} <= set(K.SEGMENT_NAMES[:run.seg.k])
    metrics = {m["model"]: m for m in rows("classification_run")}
    assert list(metrics) == K.MODEL_NAMES
    for key, name in [("train_random_forest", "RandomForest"), ("train_logistic", "LogisticRegression"), ("train_boosted_d6", "XGBoost"), ("train_boosted_d5", "GradientBoosting")]:
        m, = rows(key)
        assert m == {k: v for k, v in metrics[name].items() if not k.startswith("cv_")}
        assert all(0 <= m[c] <= 1 for c in q_models.METRICS) and m["auc"] >= 0.9
    for r in rows("cross_validate_auc"):
        assert 0.5 <= r["cv_auc_mean"] <= 1 and 0 <= r["cv_auc_std"] <= 0.5
    importances = rows("tree_importance") + rows("linear_importance")
    for n in K.MODEL_NAMES:
        mine = [x["importance"] for x in importances if x["model"] == n]
        assert len(mine) == 8 and sum(mine) == pytest.approx(1.0)
        ranked = [x["importance"] for x in rows("importance_ranked") if x["model"] == n.lower()]
        assert ranked == sorted(ranked, reverse=True)
    run_row, = rows("training_run")
    assert (run_row["k_optimal"], run_row["best_model"], run_row["train_size"]) == (run.seg.k, run.cls.best, run.cls.train_size)
    assert run_row["test_size"] == -(-customers // 5) and run_row["target_0"] + run_row["target_1"] == customers
    inventory, = rows("model_inventory")
    assert inventory["best_model"] == run.cls.best and all(inventory["segments"].split(","))
    points = rows("roc_points")
    for n, tm in run.cls.models.items():
        assert sum(p["model"] == n for p in points) == tm.metrics["roc"].count()


def test_stores_and_scores(rows, run):
    scored = rows("score_customers")
    assert len(scored) == run.features.count() and all(0 <= s["probability"] <= 1 and s["segment_name"] for s in scored)
    sections = {(s["section"], s["model"]) for s in rows("metrics_store")}
    assert sections >= {(s, n) for s in ("metrics", "confusion", "roc", "importance") for n in K.MODEL_NAMES} | {("k_search", "KMeans"), ("metadata", "run")}
    kept = {r["model"]: r for r in rows("model_store")}
    assert [m for m, r in kept.items() if not r["loaded"]] == ["damaged"]
    assert [m for m, r in kept.items() if r["is_default"]] == [run.cls.best.lower()]
    assert [m for m, r in kept.items() if r["is_default_without_best"]] == [K.MODEL_NAMES[0].lower()]


def test_live_purchases_by_the_fitted_models(spark, rows, run):
    out = rows("stream_score_fitted")
    known = {r["customer_id"] for r in run.features.collect()}
    assert out and {r["customer_id"] for r in out} <= known
    assert {r["model_used"] for r in out} == {run.cls.best} and all(0 <= r["probability"] <= 1 for r in out)


# ---------------------------------------------------------------- the fits themselves

@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.7, (70, 2)) for c in ((0, 0), (3, 1), (1, 4))])
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1])))).astype(float)
    rows = [(i, float(a), float(b), float(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "customer_id long, a double, b double, label double, fold int")
    return x, y, np.arange(len(x)) % 3, df


def test_lloyd_and_silhouette_equal_plain_ones(points, monkeypatch):
    x, _, _, df = points
    monkeypatch.setattr("custlens.plans.blocks.BLOCK_ROWS", 50)   # several blocks
    blocks = pack(df, "customer_id", ["a", "b"])
    fits = KM.fit_all(blocks, 2, [2, 3, 4], [1, 2, 3])
    assert [(f.k, f.seed) for f in fits] == [(k, s) for k in (2, 3, 4) for s in (1, 2, 3)]
    for f, s in zip(fits, KM.squared_silhouettes(blocks, 2, fits)):
        d = ((x[:, None] - f.centres) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert f.inertia == pytest.approx(d.min(axis=1).sum())
        assert all(np.allclose(x[near == c].mean(axis=0), f.centres[c], atol=1e-3) for c in range(f.k))   # a fixed point
        pair = ((x[:, None] - x) ** 2).sum(axis=2)
        a = np.array([pair[i][near == near[i]].sum() / max(1, (near == near[i]).sum() - 1) for i in range(len(x))])
        b = np.array([min(pair[i][near == c].mean() for c in set(near) - {near[i]}) for i in range(len(x))])
        assert s == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    assert KM.best_of([f for f in fits if f.k == 3]).inertia < 1.05 * sum(((x[70 * c:70 * c + 70] - x[70 * c:70 * c + 70].mean(axis=0)) ** 2).sum() for c in range(3))


def test_logistic_folds_equal_separate_fits(points):
    x, y, fold, df = points
    blocks = pack(df, "customer_id", ["a", "b"], ["label", "fold"])
    together = fit_all(blocks, ["a", "b"], [None, 0, 1, 2])
    for f, m in zip([None, 0, 1, 2], together):
        alone, = fit_all(blocks, ["a", "b"], [f])
        assert np.allclose(alone.coefficients + [alone.intercept], m.coefficients + [m.intercept], atol=1e-6)
        keep = np.ones(len(x), bool) if f is None else fold != f
        z = np.column_stack(((x[keep] - x[keep].mean(axis=0)) / x[keep].std(axis=0), np.ones(keep.sum())))
        w = np.array(m.coefficients + [m.intercept])
        p = 1 / (1 + np.exp(-z @ w))
        assert np.abs(z.T @ (p - y[keep]) + np.append(w[:2], 0)).max() < 1e-6   # the optimum


def _first_split(x, y, second):
    """Brute force: the best split of the root over all values."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = None
    for j in range(x.shape[1]):
        for cut in sorted(set(x[:, j]))[:-1]:
            left = x[:, j] <= cut
            if second:
                if min(h[left].sum(), h[~left].sum()) < B.LEAST_HESSIAN:
                    continue
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + B.LAMBDA) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + B.LAMBDA)
            else:
                gain = left.sum() * (~left).sum() / len(y) * (g[left].mean() - g[~left].mean()) ** 2
            if best is None or gain > best[0] + 1e-12:
                lam = B.LAMBDA if second else 0
                best = gain, j, cut, *(-g[m].sum() / (h[m].sum() + lam) for m in (left, ~left))
    return best


@pytest.mark.parametrize("second", [True, False])
def test_first_tree_and_folds_of_boosting(points, monkeypatch, second):
    x, y, fold, df = points
    monkeypatch.setattr(B, "bin_edges", lambda frame, features: [sorted(set(c))[:-1] for c in x.T.tolist()])   # every value has its own bin
    monkeypatch.setattr("custlens.plans.blocks.BLOCK_ROWS", 60)
    blocks = pack(df, "customer_id", ["a", "b"], ["label", "fold"])
    models = B.fit_all(blocks, df, ["a", "b"], [B.Spec(1, second, f) for f in (None, 0, 1)], 1, 0.1)
    for f, m in zip((None, 0, 1), models):
        keep = np.ones(len(x), bool) if f is None else fold != f
        gain, j, cut, left, right = _first_split(x[keep], y[keep], second)
        t = m.trees[0]
        assert t["feature"][0] == j and m.gains[j] == pytest.approx(gain)
        inside = x[keep][:, j] <= m.edges[j][t["cut"][0]]
        assert (inside == (x[keep][:, j] <= cut)).all()
        assert np.allclose(t["value"][1:], [0.1 * left, 0.1 * right])


def test_boosting_learns_and_one_class_is_constant(points):
    x, y, _, df = points
    blocks = pack(df, "customer_id", ["a", "b"], ["label", "fold"])
    m, = B.fit_all(blocks, df, ["a", "b"], [B.Spec(3, True)], 12, 0.3)
    s = np.array([r["score"] for r in m.score(df).orderBy("customer_id").collect()])
    base = y.mean()
    assert -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean() < 0.8 * -(base * np.log(base) + (1 - base) * np.log(1 - base))
    ones = df.withColumn("label", F.lit(1.0))
    blocks = pack(ones, "customer_id", ["a", "b"], ["label", "fold"])
    m, = B.fit_all(blocks, ones, ["a", "b"], [B.Spec(2, True)], 2, 0.1)
    assert min(r["score"] for r in m.score(ones).collect()) > 0.99
    logit, = fit_all(blocks, ["a", "b"], [None])
    assert min(r["score"] for r in logit.score(ones).collect()) > 0.99


def test_boosting_sends_the_driver_a_few_numbers_a_node(points, monkeypatch):
    """Only class counts are summed up on the driver; histograms meet in the tasks."""
    _, _, _, df = points
    sent, reduced = [], B.reduced

    def seen(*a, **k):
        sent.append(reduced(*a, **k))
        return sent[-1]
    monkeypatch.setattr(B, "reduced", seen)
    blocks = pack(df, "customer_id", ["a", "b"], ["label", "fold"])
    B.fit_all(blocks, df, ["a", "b"], [B.Spec(2, True), B.Spec(2, False, 0)], 2, 0.1)
    assert sum(len(v) for v in sent) == 4


def test_silhouette_distances_hold_no_third_axis():
    import tracemalloc
    from custlens.plans import silhouette as S
    rng = np.random.default_rng(1)
    x, reps = rng.normal(size=(64, 7)), rng.normal(size=(2000, 7))
    tracemalloc.start()
    d = S._distance(x, reps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * d.nbytes
    assert np.allclose(d, [np.linalg.norm(reps - r, axis=1) for r in x])


def test_sums_of_clusters_are_those_of_the_nearest_centres():
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(500, 3)), rng.normal(size=(4, 3))
    centres[3] = centres[1]   # a centre that comes twice: the first one has the rows
    d = ((x[:, None] - centres) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    v = KM._cluster_sums([centres])(None, x, None)
    assert list(v[:4]) == [(near == i).sum() for i in range(4)] and v[3] == 0
    assert np.allclose(v[4:16].reshape(4, 3), [x[near == i].sum(axis=0) for i in range(4)])
    assert v[16] == pytest.approx(d.min(axis=1).sum())


def test_boosting_makes_few_jobs_and_leaves_no_margins(spark, points, monkeypatch):
    """A pass is one job without a planned query, and written margins go when nobody reads them any more."""
    from custlens.sources.files import path_exists
    _, _, _, df = points
    monkeypatch.setattr(B, "CUT_EVERY", 1)
    monkeypatch.setattr("custlens.plans.blocks.BLOCK_ROWS", 60)
    blocks = pack(df, "customer_id", ["a", "b"], ["label", "fold"])
    written, note = [], B.delete_at_exit
    monkeypatch.setattr(B, "delete_at_exit", lambda s, path: written.append(path) or note(s, path))
    sc = spark.sparkContext
    sc.setJobGroup("boosting-test", "boosting")
    try:
        B.fit_all(blocks, df, ["a", "b"], [B.Spec(2, True), B.Spec(2, False, 0)], 3, 0.1)
        jobs = len(sc.statusTracker().getJobIdsForGroup("boosting-test"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 24   # 6 passes, 2 checkpoints of 2 jobs, bins, class counts
    assert len(written) == 2 and not any(path_exists(spark, w) for w in written)


def test_leaves_are_those_of_a_walk():
    from custlens.plans.fitted import leaf_of
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 256, (300, 4)).astype(np.uint8)
    feature, cut = np.where(rng.random(31) < 0.3, -1, rng.integers(0, 4, 31)), rng.integers(0, 255, 31)
    feature[15:] = -1

    def walk(row):
        at = 0
        while feature[at] >= 0:
            at = 2 * at + 1 + (row[feature[at]] > cut[at])
        return at
    assert leaf_of(bins, feature, cut, 4).tolist() == [walk(r) for r in bins]


def test_second_order_sums_carry_no_row_counts():
    trees = [B._Tree(2), B._Tree(2)]
    sums, sizes = B._histograms([B.Spec(2, True), B.Spec(2, False, 1)], trees, 0, [3, 2])
    rng = np.random.default_rng(4)
    bins, extra = np.stack([rng.integers(0, 3, 50), rng.integers(0, 2, 50)], axis=1).astype(np.uint8), np.stack([rng.integers(0, 2, 50), rng.integers(0, 3, 50)]).astype(float)
    second, first = sums(bins, extra, np.zeros((2, 50)))
    assert sizes == [(0, 1), (1, 1)] and len(second) == 2 * 5 and len(first) == 3 * 5
    keep = extra[1] != 1
    assert np.allclose(second[:3], np.bincount(bins[:, 0], 0.5 - extra[0], 3)) and np.allclose(second[3:6], np.bincount(bins[:, 0], minlength=3) * 0.25)
    assert np.allclose(first[6:9], np.bincount(bins[keep, 0], minlength=3)) and np.allclose(first[9:11], np.bincount(bins[keep, 1], (0.5 - extra[0])[keep], 2))
