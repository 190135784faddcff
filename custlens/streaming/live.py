"""Live purchases on Structured Streaming.

* S1 ``purchase_stream``: purchase events from a file source in bounded micro-batches.
* S2 ``run_customer_state``: Spark's stateful streaming aggregation per customer (count, exact
  sum, latest time) in update mode; each micro-batch's changed rows are written to a
  batch-keyed folder, so a replayed batch overwrites itself (idempotent), and the current
  state is the latest row per customer.
* S3-S6 ``run_live_pipeline``: a stateful processor keeps each customer's stored features (the query's
  initial state, read once) and running live totals in the state store, a bucket of customers per state, and
  emits every purchase with them (purchases of one customer in arrival order), so a micro-batch reads no feature table; a
  ``foreachBatch`` sink then appends the purchases to the history (S4), scores those of known
  customers (S3), appends the predictions to the log (S5) and rewrites the live statistics over
  the latest 200 predictions (S6 / D20).  Every write is keyed by batch id.

State survives restarts through the checkpoint folder (under ``spark.checkpoint.dir``).  The
pandas step sees one bucket's purchases of one micro-batch at a time; batches are bounded by the
bytes of their files (at least one file), so that many small files do not make as many batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from custlens import constants as K
from custlens.functions.exact import half_even_ratio
from custlens.functions.text import ts_text
from custlens.operators import predicates as P
from custlens.sources import tables as S
from custlens.sources.files import path_exists

BATCH_BYTES = 64 << 20   # of event files in a micro-batch


def source_path(sf_dir: str, name: str = "events") -> str:
    """A file source reads a directory or a glob; a single table file becomes a glob of itself."""
    base = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return base[:-2] + "[" + base[-2] + "]" + base[-1]


def purchase_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Purchases as a stream of live rows (event_id kept as the arrival tie-break), ``BATCH_BYTES`` of files
    at a time, or ``max_files``."""
    bound = ("maxBytesPerTrigger", BATCH_BYTES) if max_files is None else ("maxFilesPerTrigger", max_files)
    ev = spark.readStream.schema(S.EVENT_SCHEMA).option(*bound).parquet(path).where(F.col("event_type") == "purchase")
    return S.to_live_schema(ev).withColumn("event_id", F.regexp_extract("transaction_id", r"(\d+)", 1).cast("long"))


def _run(writer, ckpt: str):
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ---------------------------------------------------------------- S2

COMPACT_EVERY = 10  # batches between snapshots of the customer state change log


def run_customer_state(stream: DataFrame, out_path: str, ckpt: str, compact_every: int = COMPACT_EVERY) -> str:
    """Per-customer live totals; each batch's changed rows go to ``batch_id=<id>`` and every
    ``compact_every`` batches the log is folded into a latest-per-customer snapshot, so reading
    the state costs one snapshot plus fewer than ``compact_every`` batches."""
    agg = stream.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_live"),
        F.sum("total_amount").alias("live_sum"),
        F.max("transaction_date").alias("last_live"))

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            spark = batch.sparkSession
            snap = current_state(spark, out_path, upto=batch_id)
            snap.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .parquet(f"{out_path}_snapshots/upto={batch_id}")

    _run(agg.writeStream.outputMode("update").foreachBatch(write), ckpt)
    return out_path


def _latest_snapshot(spark: SparkSession, out_path: str, upto: int | None) -> int | None:
    base = f"{out_path}_snapshots"
    if not path_exists(spark, base):
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ids = [int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(p)
           if st.getPath().getName().startswith("upto=")
           and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]  # complete ones only
    ids = [i for i in ids if upto is None or i < upto]
    return max(ids) if ids else None


def current_state(spark: SparkSession, out_path: str, upto: int | None = None) -> DataFrame:
    """Latest state row per customer (update mode emits running totals): the newest snapshot
    plus the batches after it (up to and including ``upto`` when given)."""
    snap = _latest_snapshot(spark, out_path, upto)
    log = spark.read.parquet(out_path)
    if snap is not None:
        log = log.where(F.col("batch_id") > snap).unionByName(
            spark.read.parquet(f"{out_path}_snapshots/upto={snap}").drop("upto"))
    if upto is not None:
        log = log.where(F.col("batch_id") <= upto)
    latest = F.max_by(F.struct("n_live", "live_sum", "last_live"), F.col("batch_id"))
    return log.groupBy("customer_id").agg(latest.alias("s")).select("customer_id", "s.*")


def updated_rfm(rfm_stored: DataFrame, state: DataFrame) -> DataFrame:
    """Stored features after the live purchases: frequency += count, monetary += amount,
    recency = 0 for customers who bought; other features unchanged (as the reference)."""
    j = rfm_stored.join(state, "customer_id", "left")
    bought = F.col("n_live").isNotNull()
    return j.select(
        "customer_id",
        F.when(bought, F.lit(0).cast("long")).otherwise(F.col("recency")).alias("recency"),
        (F.col("frequency") + F.coalesce(F.col("n_live"), F.lit(0))).alias("frequency"),
        (F.col("monetary").cast("decimal(18,2)") + F.coalesce(F.col("live_sum"), F.lit(0)))
        .cast("double").alias("monetary"),
        "avg_order_value", "customer_lifetime_days", "purchase_frequency", "product_diversity")


# ---------------------------------------------------------------- S3-S6

@dataclass
class LivePaths:
    history: str
    predictions: str
    stats: str
    latest: str  # batch-keyed snapshots of the newest 200 predictions (the live log)


#: Stored features that live scoring takes as they are.
STORED = ["avg_order_value", "purchase_frequency", "product_diversity", "customer_lifetime_days"]
#: Customers are dealt over at least this many states, whose rows a task handles together, and over more when
#: these would hold more than ``BUCKET_CUSTOMERS``.  The number is kept with the checkpoint.
BUCKETS, BUCKET_CUSTOMERS = 48, 100_000
_KEY = ["cid", "nameless"]   # the customer's id without nulls, and whether it was null
_KEPT = ("known boolean, frequency long, monetary_cents long, avg_order_value double, purchase_frequency double, product_diversity double, "
         "customer_lifetime_days double, live_n long, live_cents long")
STATE_COLS = [c.split()[0] for c in _KEPT.split(", ")]
RUNNING_SCHEMA = f"transaction_id string, cid long, nameless boolean, transaction_date timestamp, amount double, status string, event_id long, cents long, {_KEPT}"
RUNNING_COLS = [c.split()[0] for c in RUNNING_SCHEMA.split(", ")]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CustomerState(StatefulProcessor):
    """The stored features and running live totals of a bucket's customers, kept in the state store as one
    Arrow table: a micro-batch costs a few calls per bucket, whatever the number of customers.

    The features come in once, as the query's initial state; a customer without them is unknown."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("customers", "customers binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        import pandas as pd
        rows = initialState.assign(known=True, live_n=0, live_cents=0)
        self._keep(pd.concat([self._held(), _typed(rows)], ignore_index=True).drop_duplicates(_KEY, keep="last"))

    def handleInputRows(self, key, rows, timerValues):
        """The purchases of one micro-batch, each customer's in arrival order, with what is known and the running totals."""
        import pandas as pd
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("event_id", kind="mergesort", ignore_index=True)
        held = self._held()
        pdf = pdf.merge(held, on=_KEY, how="left")   # held has a customer once; the order stays
        by = pdf.assign(cents=pdf["cents"].fillna(0).astype("int64")).groupby(_KEY, sort=False)
        pdf["known"] = pdf["known"].fillna(False)
        pdf["live_n"] = pdf["live_n"].fillna(0) + by.cumcount() + 1
        pdf["live_cents"] = pdf["live_cents"].fillna(0) + by["cents"].cumsum()
        now = _typed(pdf.drop_duplicates(_KEY, keep="last"))
        self._keep(pd.concat([held, now], ignore_index=True).drop_duplicates(_KEY, keep="last"))
        yield pdf[RUNNING_COLS]

    def _held(self):
        import pyarrow as pa
        if not self.state.exists():
            return _typed(None)
        return _typed(pa.ipc.open_stream(bytes(self.state.get()[0])).read_all().to_pandas(types_mapper=_nullable().get))

    def _keep(self, pdf) -> None:
        import pyarrow as pa
        table, out = pa.Table.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.state.update((out.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


def _nullable() -> dict:
    import pandas as pd
    import pyarrow as pa
    return {pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype(), pa.float64(): pd.Float64Dtype()}


def _typed(pdf):
    """The state's columns, with types that hold nulls; the key as it comes with the purchases."""
    import pandas as pd
    kinds = {"cid": "int64", "nameless": "bool", **{c: {"long": "Int64", "double": "Float64", "boolean": "boolean"}[t] for c, t in (f.split() for f in _KEPT.split(", "))}}
    return (pd.DataFrame(columns=list(kinds)) if pdf is None else pdf[list(kinds)]).astype(kinds)


def bucket_count(spark: SparkSession, ckpt: str, rfm_stored: DataFrame) -> int:
    """The number of states: by the stored customers when the query first starts, as the checkpoint has it afterwards."""
    path = f"{ckpt}/buckets"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        n = max(BUCKETS, rfm_stored.count() // BUCKET_CUSTOMERS)
        spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["buckets"]


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    c = F.col("customer_id")
    return df.select(F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket"), F.coalesce(c, F.lit(0)).cast("long").alias("cid"), c.isNull().alias("nameless"),
                     *[x for x in df.columns if x != "customer_id"]).groupBy("bucket")


def live_features(stream: DataFrame, rfm_stored: DataFrame, buckets: int) -> DataFrame:
    """Every live purchase with its customer's stored features and running purchase count and amount
    (cents).  The stored features are read once, when the query first starts; after that a batch touches
    its own customers' buckets only."""
    s = stream.withColumn("cents", (F.col("total_amount") * 100).cast("long")).drop("total_amount")
    stored = rfm_stored.select("customer_id", F.col("frequency").cast("long").alias("frequency"),
                               (F.col("monetary").cast("decimal(18,2)") * 100).cast("long").alias("monetary_cents"), *[F.col(c).cast("double").alias(c) for c in STORED])
    running = _bucketed(s, buckets).transformWithStateInPandas(CustomerState(), RUNNING_SCHEMA, "Append", "None", initialState=_bucketed(stored, buckets))
    return running.select("transaction_id", F.when(~F.col("nameless"), F.col("cid")).alias("customer_id"), *[c for c in RUNNING_COLS[1:] if c not in _KEY],
                          (F.col("cents") / 100).cast("decimal(18,2)").alias("total_amount"))


def latest_predictions(log: DataFrame, n: int = K.LIVE_LOG_CAP) -> DataFrame:
    """The n predictions that arrived last, newest first (by batch, then event; a late
    event is new when it arrives).  A top-n, not a global sort."""
    return log.orderBy(F.desc("batch_id"), F.desc("event_id")).limit(n)


def kept_log(spark: SparkSession, latest: str) -> DataFrame:
    """The live log as the last batch left it: at most the kept predictions are read."""
    batches = spark.read.parquet(latest)
    last = batches.select(F.max("snapshot")).scalar()
    return batches.where(F.col("snapshot") == last).drop("snapshot")


def live_stats(latest: DataFrame) -> DataFrame:
    """Totals over the given predictions; zeros and an empty map when there are none."""
    seg = latest.groupBy(F.coalesce(F.col("segment_name"), F.lit("Unknown")).alias("k")) \
                .agg(F.count(F.lit(1)).alias("v"))
    dist = seg.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("segment_distribution"))
    tot = latest.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("will_purchase")).alias("will_purchase_count"),
        F.sum(F.round(F.col("probability") * 10_000).cast("long")).alias("_s"))
    # the mean of 4-digit probabilities, rounded half-even on integers
    tot = tot.withColumn("avg_probability", F.when(F.col("total_predictions") == 0, F.lit(0.0)).otherwise(half_even_ratio("_s", "total_predictions * 10000", 4)))
    empty = F.create_map().cast("map<string,bigint>")
    ds = dist.select(F.struct("segment_distribution")).scalar()
    return tot.select(
        "total_predictions", "will_purchase_count",
        (F.col("total_predictions") - F.col("will_purchase_count")).alias("will_not_purchase_count"),
        "avg_probability",
        F.coalesce(ds["segment_distribution"], empty).alias("segment_distribution"))


def score_live_batch(batch: DataFrame, scorer) -> DataFrame:
    """S3: each purchase of a known customer, scored with frequency and monetary including every
    live purchase up to it and recency 0; all of it comes with the batch, from the state."""
    feats = batch.where("known").select(   # unknown customers are kept in history, not scored
        "transaction_id", "event_id", "customer_id", "amount", "transaction_date",
        F.lit(0.0).alias("recency"),
        (F.col("frequency") + F.col("live_n")).alias("frequency"),
        ((F.col("monetary_cents") + F.col("live_cents")) / 100).cast("decimal(18,2)").cast("double").alias("monetary"),
        "avg_order_value", "purchase_frequency", "product_diversity", "customer_lifetime_days")
    return scorer(P.default_features_live(feats))


def run_live_pipeline(stream: DataFrame, paths: LivePaths, ckpt: str, rfm_stored: DataFrame, scorer) -> LivePaths:
    spark = stream.sparkSession

    def per_batch(batch: DataFrame, batch_id: int):
        batch = batch.persist()
        # History append (batch-keyed, idempotent)
        batch.select("transaction_id", "customer_id", "transaction_date", "amount", "total_amount", "status") \
             .write.mode("overwrite").parquet(f"{paths.history}/batch_id={batch_id}")
        # S3: scored purchases appended to the prediction log
        scored_path = f"{paths.predictions}/batch_id={batch_id}"
        score_live_batch(batch, scorer).write.mode("overwrite").parquet(scored_path)
        # The live log after this batch = last 200 of (the log after the previous batch +
        # this batch's predictions): each batch reads at most 200 old rows, not the whole log
        prev = f"{paths.latest}/snapshot={batch_id - 1}"
        if batch_id == 0 or path_exists(spark, f"{prev}/_SUCCESS"):
            log = spark.read.parquet(scored_path).withColumn("batch_id", F.lit(batch_id))
            if batch_id > 0:
                log = log.unionByName(spark.read.parquet(prev))
        else:  # snapshot missing (e.g. a new output folder on an old checkpoint): rebuild once
            log = spark.read.parquet(paths.predictions).where(F.col("batch_id") <= batch_id)
        latest_path = f"{paths.latest}/snapshot={batch_id}"
        latest_predictions(log).write.mode("overwrite").parquet(latest_path)
        # Statistics over that log
        live_stats(spark.read.parquet(latest_path)).withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("overwrite").parquet(f"{paths.stats}/batch_id={batch_id}")
        batch.unpersist()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        buckets = bucket_count(spark, ckpt, rfm_stored)
        _run(live_features(stream, rfm_stored, buckets).writeStream.outputMode("append").foreachBatch(per_batch), ckpt)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return paths


def prediction_log_view(log: DataFrame) -> DataFrame:
    """The prediction record with nested segment / prediction structs (as the reference's log)."""
    return log.select(
        "transaction_id", "customer_id", "amount", ts_text("transaction_date").alias("timestamp"),
        # live purchases name neither; the record has the fields all the same
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("payment_method"),
        F.struct(F.col("segment_id"), F.col("segment_name"), F.col("confidence")).alias("segment"),
        F.struct(F.col("will_purchase"), F.col("probability"), F.col("model_used")).alias("prediction"),
        "recommendation")
