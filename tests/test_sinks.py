"""Sinks and stores: CSV round trip, migration rules, bucketed layout, model loading with a bad
artifact, metrics JSON round trip."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from custlens.session import scratch_path
from custlens.plans.fitted import BoostedModel, LogisticModel, PipelineClassifier
from custlens.sources import files, stores
from custlens.sources import tables as S
from custlens.sources.feature_store import rfm_features
from tests.conftest import SF_SMALL


def test_csv_round_trip_and_migration(spark):
    tx = S.transactions(spark, SF_SMALL)
    tx_csv = files.write_csv(tx, scratch_path(spark, "t-csv"))
    back = files.scan_csv(spark, tx_csv, S.TRANSACTION_SCHEMA)
    assert back.count() == tx.count()
    assert sorted(back.collect()) == sorted(tx.collect())
    rfm_csv = files.write_csv(rfm_features(spark, SF_SMALL), scratch_path(spark, "r-csv"))
    counts = files.migrate_csv(spark, tx_csv, rfm_csv, S.TRANSACTION_SCHEMA,
                               scratch_path(spark, "tt"), scratch_path(spark, "rt"))
    assert counts == {"transactions": tx.count(), "rfm_features": rfm_features(spark, SF_SMALL).count()}
    # missing transactions: a warning, RFM still migrated; missing RFM: abort
    counts = files.migrate_csv(spark, scratch_path(spark, "absent"), rfm_csv, S.TRANSACTION_SCHEMA,
                               scratch_path(spark, "tt"), scratch_path(spark, "rt"))
    assert set(counts) == {"rfm_features"}
    with pytest.raises(FileNotFoundError):
        files.migrate_csv(spark, tx_csv, scratch_path(spark, "absent"), S.TRANSACTION_SCHEMA,
                          scratch_path(spark, "tt"), scratch_path(spark, "rt"))


def test_bucketed_layout_joins_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = rfm_features(spark, SF_SMALL)
        files.layout_by_customer(r, "t_rfm_a", scratch_path(spark, "ba"), 4)
        files.layout_by_customer(r, "t_rfm_b", scratch_path(spark, "bb"), 4)
        j = spark.table("t_rfm_a").join(spark.table("t_rfm_b"), "customer_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # co-bucketed: the join reads both sides in place
        assert j.count() == r.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_model_store_skips_bad_artifact(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (0.0, 0.5), (1.0, 4.0)], "label double, x double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                         LogisticRegression(maxIter=5)]).fit(df)
    given = {"LogisticRegression": LogisticModel(["x"], [1.0], [2.0], [0.5], -0.25), "Other": PipelineClassifier(m, ["x"]),
             "Boosted": BoostedModel(["x"], [[0.7, 2.0]], 0.1, [{"feature": [0, -1, -1], "cut": [1, 0, 0], "value": [0.0, -0.5, 0.5]}], [1.0])}
    paths = stores.save_models(spark, given, scratch_path(spark, "models"))
    paths["randomforest"] = scratch_path(spark, "missing")
    loaded, default = stores.load_models(spark, paths, "RandomForest")
    assert set(loaded) == {"logisticregression", "other", "boosted"} and default == "logisticregression"
    loaded, default = stores.load_models(spark, paths, "Boosted")
    assert default == "boosted"
    for name, m in given.items():
        scored = [r["score"] for r in m.score(df).orderBy("x").collect()]
        assert [r["score"] for r in loaded[name.lower()].score(df).orderBy("x").collect()] == scored and scored == sorted(scored)



def test_metrics_round_trip(spark):
    df = spark.createDataFrame([("metrics", "RandomForest", "auc", 0, 0.9, None), ("mapping", "KMeans", "0", 1, None, "Loyal")], stores.DOCUMENT_DDL)
    path = stores.write_metrics(df, scratch_path(spark, "metrics"))
    assert sorted(stores.read_metrics(spark, path).collect(), key=repr) == sorted(df.collect(), key=repr)


def test_csv_keeps_microseconds_breaks_and_quotes(spark):
    import datetime as dt

    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("t", T.TimestampType()), T.StructField("s", T.StringType())])
    data = [(dt.datetime(2024, 1, 2, 3, 4, 5, 678901), 'a "quoted", text\nof two lines'), (dt.datetime(2024, 1, 2), ""), (None, None), (dt.datetime(1999, 12, 31, 23, 59, 59, 1), "back\\slash\\")]
    path = files.write_csv(spark.createDataFrame(data, schema), scratch_path(spark, "csv"))
    assert sorted(map(tuple, files.scan_csv(spark, path, schema, line_breaks=True).collect()), key=repr) == sorted(data, key=repr)
    with pytest.raises(Exception):   # not read as other rows
        files.scan_csv(spark, path, schema).collect()


def test_a_large_csv_file_is_split(spark):
    from pyspark.sql import functions as F
    df = spark.range(20_000).select("id", F.repeat(F.lit("x"), 40).alias("s"))
    path = files.write_csv(df.coalesce(1), scratch_path(spark, "csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    try:
        back = files.scan_csv(spark, path, df.schema)
        assert back.rdd.getNumPartitions() > 3 and back.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_signature_sees_a_leaf_file(spark, tmp_path):
    from pyspark.sql import functions as F

    from custlens.sources import feature_store as FS
    path = f"{tmp_path}/events.parquet"
    df = spark.range(6).withColumn("p", F.col("id") % 2)
    df.write.partitionBy("p").parquet(path)
    before = FS._signature(spark, str(tmp_path), ["events"])
    assert before == FS._signature(spark, str(tmp_path), ["events"])
    df.where("p = 1").drop("p").coalesce(1).write.mode("overwrite").parquet(f"{path}/p=1")
    assert before != FS._signature(spark, str(tmp_path), ["events"])


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    import pytest

    from custlens import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
