"""Model invariants on the small fixture with small settings (the library defaults are the
reference's; registered queries use them)."""

import pytest
from pyspark.sql import functions as F

from custlens import constants as K
from custlens.plans import models as M
from custlens.sources.feature_store import rfm_features
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def seg(spark):
    return M.segmentation_run(rfm_features(spark, SF_SMALL), k_range=(3, 4), starts=2)


@pytest.fixture(scope="module")
def cls(seg):
    return M.classification_run(seg.named, names=["RandomForest", "LogisticRegression"], cv_folds=2)


def test_segmentation(seg):
    assert 3 <= seg.k <= 4
    ks = [r["k"] for r in seg.search.collect()]
    assert ks == [3, 4]
    names = {r["segment_name"] for r in seg.named.select("segment_name").distinct().collect()}
    assert names <= set(K.SEGMENT_NAMES[:seg.k])
    assert seg.named.count() == rfm_features(seg.named.sparkSession, SF_SMALL).count()


def test_classification(cls):
    assert cls.best in ("RandomForest", "LogisticRegression")
    for r in cls.metrics.collect():
        for m in ("accuracy", "precision", "recall", "f1", "auc"):
            assert 0.0 <= r[m] <= 1.0
        assert r["cv_auc_mean"] is not None and r["cv_auc_std"] >= 0.0
    assert cls.test_size == -(-(cls.train_size + cls.test_size) // 5)  # ceil(0.2 n)


def test_importances_sum_to_one(cls):
    for name in ("RandomForest", "LogisticRegression"):
        imp = M.importance(cls.models[name])
        assert len(imp) == len(K.CLASSIFIER_FEATURES)
        assert abs(sum(v for _, v in imp) - 1.0) < 1e-9


def test_scoring(spark, seg, cls):
    scored = M.score_customers(rfm_features(spark, SF_SMALL), seg, cls.models[cls.best], cls.best)
    rows = scored.collect()
    assert rows and all(0.0 <= r["probability"] <= 1.0 and 0.0 < r["confidence"] <= 1.0 for r in rows)
    assert all(r["will_purchase"] == (r["probability"] > 0.5) or abs(r["probability"] - 0.5) < 1e-4 for r in rows)
    one = spark.createDataFrame([(10001, 15.0, 8, 1250.50, 156.31, 2.3, 0.65, 365)],
                                "customer_id long, recency double, frequency long, monetary double, "
                                "avg_order_value double, purchase_frequency double, product_diversity double, "
                                "customer_lifetime_days long")
    r = M.score_customers(one, seg, cls.models[cls.best], cls.best).first()
    assert r["segment_name"] and r["recommendation"]


def test_requested_models(spark, seg, cls):
    assert M.choose_model(cls.models, cls.best, "random forest").name == "RandomForest"
    assert M.choose_model(cls.models, cls.best, None).name == cls.best
    assert M.choose_model(cls.models, "gone", " ").name == "RandomForest"
    with pytest.raises(M.UnknownModel, match="Model Nope not found"):
        M.choose_model(cls.models, cls.best, "Nope")
    names = ["Random Forest", "logisticregression", None, "Nope", "xgboost"]
    asked = [(i, *["1"] * 5, "0.5", "3", n) for i, n in enumerate(names)] + [(9, "x", *["1"] * 4, "0.5", "3", None)]
    cols = K.FEATURES[:5] + ["product_diversity", "customer_lifetime_days"]
    out = {r["customer_id"]: r for r in M.score_requests(spark.createDataFrame(asked, "customer_id long, " + ", ".join(f"{c} string" for c in cols) + ", model_name string"), seg, cls.models, cls.best).collect()}
    assert [out[i]["model_used"] for i in range(5)] == ["RandomForest", "LogisticRegression", cls.best, None, None]
    assert out[3]["error"] == "Model Nope not found" and out[4]["error"] == "Model xgboost not found"
    assert out[9]["error"].startswith("Invalid value for recency") and out[9]["probability"] is None
