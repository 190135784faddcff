"""Stored tables the reports read: the transaction history (the reference's ``transactions``)
and the RFM feature table (its ``rfm_features``).

Each is built once per session and source snapshot and written under the shared checkpoint
folder; it is rebuilt whenever a source file changes (size or modification time), so a report
never reads stale data.  The D1-D8 and A8 queries themselves always compute from the source
tables."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.operators import rfm
from custlens.sources import tables as S

_LOCK = threading.Lock()
_STORE: dict = {}

SOURCES = {"history": ["lineitem", "orders", "part", "events"], "stored": ["lineitem", "orders", "part"]}


def _signature(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    sig = []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(S.table_path(sf_dir, n))
        leaves = p.getFileSystem(conf).listFiles(p, True)  # a table is a file or a tree of files
        found = []
        while leaves.hasNext():
            st = leaves.next()
            found.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
        sig.append((n, hashlib.sha256(repr(sorted(found)).encode()).hexdigest()))
    return tuple(sig)


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history: transactions (status null) and live purchases (status set)."""
    sig = _signature(spark, sf_dir, SOURCES["history"])
    key = (spark.sparkContext.applicationId, sf_dir, "history-table")
    with _LOCK:
        hit = _STORE.get(key)
        if hit is None or hit[0] != sig:
            from custlens.functions.materialize import materialize
            hit = (sig, materialize(S.history(spark, sf_dir), "history"))
            _STORE[key] = hit
        return hit[1]


def rfm_features(spark: SparkSession, sf_dir: str, which: str = "history") -> DataFrame:
    """The feature table over ``history`` (transactions + live) or ``stored`` (transactions)."""
    hist = history_table(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, which)
    with _LOCK:
        hit = _STORE.get(key)
        if hit is None or hit[0] is not hist:
            src = hist if which == "history" else hist.where(F.col("status").isNull()).drop("amount", "status")
            from custlens.functions.materialize import materialize
            hit = (hist, materialize(rfm.rfm_table(src), "rfm-features"))
            _STORE[key] = hit
        return hit[1]


def given_segments(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The stored segment assignment of the deterministic segmentation (H6 output over the
    stored features), named by D19/E1 - the segment columns the reports read."""
    feats = rfm_features(spark, sf_dir, "history")
    key = (spark.sparkContext.applicationId, sf_dir, "segments", k)
    with _LOCK:
        hit = _STORE.get(key)
        if hit is None or hit[0] is not feats:
            from custlens.operators import segments as G
            named, _ = G.named_segmentation(feats, k)
            from custlens.functions.materialize import materialize
            hit = (feats, materialize(named, "segments-named"))
            _STORE[key] = hit
        return hit[1]


def page_index(spark: SparkSession, sf_dir: str, which: str):
    """The page index of the stored features (by customer) or transactions (newest first)."""
    from custlens.operators import reports as R
    from custlens.sources import pages
    base = rfm_features(spark, sf_dir, "history") if which == "rfm" else history_table(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, "pages", which)
    with _LOCK:
        hit = _STORE.get(key)
        if hit is None or hit[0] is not base:
            built = pages.build_page_index(base, lambda: [F.col("customer_id")]) if which == "rfm" else \
                pages.build_page_index(R.ordered_transactions(base), R.newest_first)
            hit = (base, built)
            _STORE[key] = hit
        return hit[1]
