"""Streaming equals batch: events split into three files are streamed one file per micro-batch."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.operators import rfm
from custlens.session import scratch_path
from custlens.sources import tables as S
from custlens.streaming import live as V
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def event_dir(spark):
    ev = S.scan_table(spark, SF_SMALL, "events")
    out = scratch_path(spark, "events-split")
    bounds = ev.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [1 / 3, 2 / 3], 1000)).first()[0]
    part = (F.when(F.unix_micros(F.col("ts").cast("timestamp")) < bounds[0], 0)
             .when(F.unix_micros(F.col("ts").cast("timestamp")) < bounds[1], 1).otherwise(2))
    for i in range(3):
        ev.where(part == i).coalesce(1).write.mode("overwrite").parquet(f"{out}/part{i}")
    return out


def _stream(spark, event_dir):
    return V.purchase_stream(spark, f"{event_dir}/part*/*.parquet", max_files=1)


def test_customer_state_stream_equals_batch(spark, event_dir):
    out = scratch_path(spark, "state")
    V.run_customer_state(_stream(spark, event_dir), out, scratch_path(spark, "state-ckpt"), compact_every=2)
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    assert spark.read.parquet(f"{out}_snapshots").select("upto").distinct().count() == 1  # after batch 1
    got = V.updated_rfm(rfm.rfm_table(S.transactions(spark, SF_SMALL)), V.current_state(spark, out)).toPandas()
    from custlens.plans.registry import ORACLES as O
    want = duck(SF_SMALL).sql(O["stream_customer_state"]).df()
    assert not compare(got, want)


def test_live_pipeline_running_counts(spark, event_dir):
    stored = rfm.rfm_table(S.transactions(spark, SF_SMALL))

    def scorer(feats):  # no model: keep the features the model would see
        return feats.select("transaction_id", "event_id", "customer_id", "transaction_date", "frequency", "monetary",
                            F.lit(None).cast("string").alias("segment_name"), F.lit(True).alias("will_purchase"),
                            F.lit(0.5).alias("probability"))
    paths = V.LivePaths(*(scratch_path(spark, n) for n in ("h", "p", "s", "l")))
    V.run_live_pipeline(_stream(spark, event_dir), paths, scratch_path(spark, "live-ckpt"), stored, scorer)
    pred = spark.read.parquet(paths.predictions).toPandas()
    assert pred["batch_id"].nunique() == 3
    ev = S.scan_table(spark, SF_SMALL, "events").where("event_type = 'purchase'").toPandas()
    ev = ev.sort_values(["ts", "event_id"])
    ev["n"] = ev.groupby("user_id").cumcount() + 1
    base = stored.toPandas().set_index("customer_id")["frequency"]
    known = ev[ev["user_id"].isin(base.index)]
    want = (known.set_index("event_id")["n"] + known.set_index("event_id")["user_id"].map(base)).sort_index()
    got = pred.set_index("event_id")["frequency"].sort_index()
    assert len(got) == len(want) and (got.values == want.values).all()
    hist = spark.read.parquet(paths.history)
    assert hist.count() == len(ev)
    stats = spark.read.parquet(paths.stats).orderBy(F.desc("batch_id")).first()
    assert stats["total_predictions"] == min(200, len(known))
    # the incremental live log after the last batch = the newest 200 of the whole prediction log
    last = spark.read.parquet(f"{paths.latest}/snapshot={stats['batch_id']}").select("event_id").toPandas()
    full = V.latest_predictions(spark.read.parquet(paths.predictions)).select("event_id").toPandas()
    assert sorted(last["event_id"]) == sorted(full["event_id"])


def test_features_come_from_the_state_after_a_restart(spark, event_dir):
    """The second run gets no stored features at all: what it scores with is in the state."""
    import re
    stored = rfm.rfm_table(S.transactions(spark, SF_SMALL))
    source, ckpt = scratch_path(spark, "events-growing"), scratch_path(spark, "live-ckpt")
    paths = V.LivePaths(*(scratch_path(spark, n) for n in ("h", "p", "s", "l")))
    plans = []

    def scorer(feats):
        plans.append(feats._jdf.queryExecution().executedPlan().toString())
        return feats.select("transaction_id", "event_id", "customer_id", "transaction_date", "frequency", "monetary", "avg_order_value",
                            F.lit(None).cast("string").alias("segment_name"), F.lit(True).alias("will_purchase"), F.lit(0.5).alias("probability"))

    for i, features in [(0, stored), (1, stored.limit(0)), (2, stored.limit(0))]:
        spark.read.parquet(f"{event_dir}/part{i}").coalesce(1).write.mode("append").parquet(source)
        V.run_live_pipeline(V.purchase_stream(spark, f"{source}/*.parquet"), paths, ckpt, features, scorer)
    assert not any(re.search("Join|FileScan", p) for p in plans)
    ev = S.scan_table(spark, SF_SMALL, "events").where("event_type = 'purchase'")
    got = spark.read.parquet(paths.predictions)
    assert got.select("batch_id").distinct().count() == 3
    last = got.groupBy("customer_id").agg(F.max("frequency").alias("frequency"), F.max("monetary").alias("monetary"), F.max("avg_order_value").alias("avg"))
    live = ev.groupBy(F.col("user_id").alias("customer_id")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    want = stored.join(live, "customer_id").select("customer_id", (F.col("frequency") + F.col("n")).alias("frequency"),
                                                   (F.col("monetary").cast("decimal(18,2)") + F.col("v")).cast("double").alias("monetary"), F.col("avg_order_value").alias("avg"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_state_is_handled_by_bucket(spark, event_dir, monkeypatch):
    """A bucket's customers share their calls; nulls of the key and purchases of unknown customers are kept apart."""
    stored = rfm.rfm_table(S.transactions(spark, SF_SMALL)).where("customer_id % 3 > 0")
    calls = spark.sparkContext.accumulator(0)

    class Counted(V.CustomerState):
        def handleInitialState(self, key, initialState, timerValues):
            calls.add(1)
            super().handleInitialState(key, initialState, timerValues)
    monkeypatch.setattr(V, "CustomerState", Counted)
    monkeypatch.setattr(V, "BUCKETS", 4, raising=False)
    stream = _stream(spark, event_dir).withColumn("customer_id", F.expr("CASE WHEN customer_id % 5 = 0 THEN NULL ELSE customer_id END"))
    paths = V.LivePaths(*(scratch_path(spark, n) for n in ("h", "p", "s", "l")))

    def scorer(feats):
        return feats.select("transaction_id", "event_id", "customer_id", "transaction_date", "frequency", F.lit(None).cast("string").alias("segment_name"),
                            F.lit(True).alias("will_purchase"), F.lit(0.5).alias("probability"))
    V.run_live_pipeline(stream, paths, scratch_path(spark, "live-ckpt"), stored, scorer)
    assert 0 < calls.value <= 12 < stored.count()
    ev = S.scan_table(spark, SF_SMALL, "events").where("event_type = 'purchase'").toPandas().sort_values(["ts", "event_id"])
    ev["n"] = ev.groupby("user_id").cumcount() + 1
    base = stored.toPandas().set_index("customer_id")["frequency"]
    known = ev[ev["user_id"].isin(base.index) & (ev["user_id"] % 5 != 0)].set_index("event_id")
    got = spark.read.parquet(paths.predictions).toPandas().set_index("event_id")["frequency"].sort_index()
    want = (known["n"] + known["user_id"].map(base)).sort_index()
    assert list(got.index) == list(want.index) and (got.values == want.values).all()
    hist = spark.read.parquet(paths.history)
    assert hist.count() == len(ev) and hist.where("customer_id IS NULL").count() == (ev["user_id"] % 5 == 0).sum()


def test_small_files_share_a_micro_batch(spark, event_dir):
    """Files are read by their bytes, so that the number of batches does not grow with the number of files."""
    stored = rfm.rfm_table(S.transactions(spark, SF_SMALL))
    paths = V.LivePaths(*(scratch_path(spark, n) for n in ("h", "p", "s", "l")))

    def scorer(feats):
        return feats.select("transaction_id", "event_id", "customer_id", "transaction_date", F.lit(None).cast("string").alias("segment_name"),
                            F.lit(True).alias("will_purchase"), F.lit(0.5).alias("probability"))
    V.run_live_pipeline(V.purchase_stream(spark, f"{event_dir}/part*/*.parquet"), paths, scratch_path(spark, "live-ckpt"), stored, scorer)
    hist = spark.read.parquet(paths.history)
    assert hist.select("batch_id").distinct().count() == 1
    assert hist.count() == S.scan_table(spark, SF_SMALL, "events").where("event_type = 'purchase'").count()


def test_number_of_states_grows_with_customers_and_stays_with_the_checkpoint(spark, monkeypatch):
    stored, ckpt = spark.range(100).withColumnRenamed("id", "customer_id"), scratch_path(spark, "live-ckpt")
    monkeypatch.setattr(V, "BUCKET_CUSTOMERS", 2)
    monkeypatch.setattr(V, "BUCKETS", 4)
    assert V.bucket_count(spark, ckpt, stored) == 50
    assert V.bucket_count(spark, ckpt, stored.limit(0)) == 50
    assert V.bucket_count(spark, scratch_path(spark, "live-ckpt"), stored.limit(0)) == 4
