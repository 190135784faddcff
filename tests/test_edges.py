"""Hand-made edge frames (null keys, empty sums, single rows, duplicates, zero maxima, NaN/Inf,
unknown ids, ties, mixed date texts, invalid requests, empty logs, ids without digits)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from custlens import constants as K
from custlens.operators import affinity as A
from custlens.operators import evaluation as E
from custlens.operators import labels as L
from custlens.operators import predicates as P
from custlens.operators import reports as R
from custlens.operators import rfm
from custlens.operators import segments as G
from custlens.sources.tables import TRANSACTION_SCHEMA
from custlens.streaming import live as V
from tests.conftest import rows

D = dt.datetime


def tx(spark, data):
    return spark.createDataFrame(data, TRANSACTION_SCHEMA)


def T(i, c, d, cat="A", amt="10.00", pay="Cash"):
    from decimal import Decimal
    return (i, c, d, cat, 1, float(amt) if amt else None, Decimal(amt) if amt else None, pay)


def test_rfm_edges(spark):
    data = [
        T("1-1", 1, D(2024, 1, 1), "A", "10.00"),
        T("1-1", 1, D(2024, 1, 1), "B", "5.00"),          # repeated id: frequency counts it once
        T("1-2", 1, D(2024, 1, 11), "A", "0.12"),
        T("2-1", 2, D(2024, 1, 21, 12), "C", None),       # all-null amount
        T("3-1", None, D(2024, 2, 1), "A", "7.00"),       # null key: dropped, but sets the date
        T("4-1", 4, D(2024, 1, 31, 23, 59), "D", "1.00"), # one purchase
    ]
    out = {r["customer_id"]: r for r in rows(rfm.rfm_table(tx(spark, data), checkpoint=False))}
    assert set(out) == {1, 2, 4}
    c1 = out[1]
    assert c1["frequency"] == 2 and c1["monetary"] == 15.12
    assert c1["avg_order_value"] == 5.04                  # 15.12 / 3 rows
    assert c1["customer_lifetime_days"] == 11
    assert c1["recency"] == 22                            # (2024-02-01 + 1 day) - 2024-01-11
    assert c1["product_diversity"] == round(2 / K.N_CATEGORIES, 3)
    c2 = out[2]
    assert c2["monetary"] == 0.0 and c2["avg_order_value"] is None
    c4 = out[4]
    assert c4["customer_lifetime_days"] == 1 and c4["recency"] == 1  # 1 minute before the latest date
    assert c4["purchase_frequency"] == 30.0                           # 1 / (1 / 30), inside the clip range
    assert out[1]["purchase_frequency"] == round(2 / (11 / 30), 3)
    # the single-feature keys agree with the full table (recency has its own plan)
    for feat in ("recency", "frequency", "monetary"):
        one = {r["customer_id"]: r[feat] for r in rows(rfm.rfm_feature(tx(spark, data), feat))}
        assert one == {c: out[c][feat] for c in out}


def test_clip_bounds_exact(spark):
    df = spark.createDataFrame([(1, 1), (1, 400), (3, 1), (1, 32)], "f long, l long")
    got = [r[0] for r in df.select(rfm.purchase_frequency_col("f", "l")).collect()]
    assert got == [30.0, 0.1, 50.0, 0.938]  # 30/32 = 0.9375 -> half-even 0.938


def test_half_even_ties(spark):
    from custlens.functions.exact import half_even_ratio
    df = spark.createDataFrame([(1, 8), (3, 8), (5, 8), (1, 3)], "n long, d long")
    got = [r[0] for r in df.select(half_even_ratio("n", "d", 2)).collect()]
    assert got == [0.12, 0.38, 0.62, 0.33]


def test_clean_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), None, -float("inf"), 1.0, 2.0, 3.0)],
                               "customer_id long, " + ", ".join(f"{c} double" for c in K.FEATURES))
    r = rows(P.clean_features(df))[0]
    assert all(r[c] == 0.0 for c in K.FEATURES[:4]) and r["product_diversity"] == 2.0
    n = rows(P.nan_to_null(df))[0]
    assert n["recency"] is None and n["frequency"] == math.inf


def test_validation_reasons(spark):
    req = spark.createDataFrame([
        (1, None, "5", "1", "1", "1", "0.5", "1"),
        (2, "x", "5", "1", "1", "1", "0.5", "1"),
        (3, "1", "-5", "1", "1", "1", "0.5", "1"),
        (4, "1", "5", "1", "1", "1", "1.2", "1"),
        (5, "1", "5", "1", "1", "1", "0.5", "1"),
    ], "customer_id long, " + ", ".join(f"{c} string" for c in K.FEATURES))
    got = {r["customer_id"]: r["reason"] for r in rows(P.validate_requests(req))}
    assert got[1] == "Missing required field: recency"
    assert got[2] == "Invalid value for recency: x"
    assert got[3] == "Invalid value for frequency: -5"
    assert got[4] == "Invalid value for product_diversity: 1.2"
    assert got[5] is None


def test_model_name_and_recommendation(spark):
    df = spark.createDataFrame([("Random Forest",), (None,), ("Champions",), ("Nobody",)], "v string")
    got = [r[0] for r in df.select(P.normalize_model_name("v")).collect()]
    assert got == ["randomforest", "", "champions", "nobody"]
    rec = [r[0] for r in df.select(P.recommendation_for("v")).collect()]
    assert rec[2] == K.RECOMMENDATIONS["Champions"] and rec[3] == K.DEFAULT_RECOMMENDATION


def test_unknown_segment_fallback(spark):
    df = spark.createDataFrame([(1, 0), (2, 9)], "customer_id long, segment int")
    mp = spark.createDataFrame([(0, "Champions")], "segment int, segment_name string")
    got = {r["customer_id"]: r["segment_name"] for r in rows(P.segment_name_lookup(df, mp))}
    assert got == {1: "Champions", 2: "Segment 9"}
    got2 = {r["customer_id"]: r["segment_name"] for r in rows(P.segment_name_lookup(df, mp, fallback=False))}
    assert got2[2] is None


def test_one_row_segment_std_null(spark):
    df = spark.createDataFrame([(1, 0, "A", 1, 1, 1.0), (2, 1, "B", 2, 2, 2.0), (3, 1, "B", 4, 4, 4.0)],
                               "customer_id long, segment int, segment_name string, recency long, frequency long, monetary double")
    d0 = rows(G.segment_detail(df, 0))[0]
    assert d0["count"] == 1 and d0["std_recency"] is None
    d1 = rows(G.segment_detail(df, 1))[0]
    assert d1["std_recency"] == round(math.sqrt(2.0), 9)


def test_tied_scores_auc_and_roc(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert rows(E.auc(df))[0]["auc"] == 0.875
    roc = rows(E.roc_curve(df), ["order_key"])
    pts = [(r["fpr"], r["tpr"]) for r in roc]
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    m = rows(E.classification_metrics(df))[0]
    assert m == {"accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    cm = rows(E.confusion_matrix(df), ["actual", "predicted"])
    assert [r["n"] for r in cm] == [2, 0, 0, 0]


def test_zero_max_normalize(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)],
                               "customer_id long, frequency long, purchase_frequency double, monetary double")
    assert all(r["frequency_norm"] is None for r in rows(L.max_normalize(df)))


def test_mixed_date_texts(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-05 10:11:12",), ("garbage",)], "t string")
    got = [r[0] for r in df.select(P.parse_mixed_dates("t")).collect()]
    assert got[0] == D(2024, 1, 5) and got[1] == D(2024, 1, 5, 10, 11, 12) and got[2] is None


def test_ids_without_digits(spark):
    df = spark.createDataFrame([("abc",), ("x-",)], "transaction_id string")
    assert rows(R.max_transaction_number(df))[0]["max_transaction_number"] == 0
    df2 = spark.createDataFrame([("TXN-12",), ("7-3",), ("abc",)], "transaction_id string")
    assert rows(R.max_transaction_number(df2))[0]["max_transaction_number"] == 12


def test_empty_prediction_log(spark):
    empty = spark.createDataFrame([], "segment_name string, will_purchase boolean, probability double, "
                                      "transaction_date timestamp, event_id long")
    s = rows(V.live_stats(empty))[0]
    assert s == {"total_predictions": 0, "will_purchase_count": 0, "will_not_purchase_count": 0,
                 "avg_probability": 0.0, "segment_distribution": {}}


@pytest.mark.parametrize("block", [A.BLOCK, 2, 1])
def test_affinity_equals_literal(spark, block):
    data = [T(f"{i}", c, D(2024, 1, 1), cat) for i, (c, cat) in enumerate(
        [(1, "A"), (1, "B"), (1, "B"), (1, "C"), (2, "A"), (2, "B"), (3, "C"), (4, "A"), (4, "C"), (4, "A"),
         (None, "A"), (5, None), (6, "C")])]
    got = {(r["category_a"], r["category_b"]): r["co_occurrence"]
           for r in rows(A.category_affinity(tx(spark, data), block))}
    assert got == {("A", "B"): 2, ("A", "C"): 2, ("B", "C"): 1}


@pytest.mark.parametrize("categories", [6, 600, 5000])
def test_affinity_at_any_number_of_categories(spark, categories):
    import collections
    import itertools
    import random
    rng = random.Random(categories)
    baskets = {c: {f"c{rng.randrange(categories):04d}" for _ in range(rng.randint(1, 9))} for c in range(400)}
    df = spark.createDataFrame([(c, x) for c, s in baskets.items() for x in s], "customer_id long, product_category string")
    want = collections.Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    assert {(r[0], r[1]): r[2] for r in A.category_affinity(df).collect()} == want


def test_auc_of_counts_beyond_a_long(spark):
    """4e9 of each class: the product of the counts needs a decimal."""
    from custlens.operators import evaluation as E
    n = 4_000_000_000
    sc = spark.createDataFrame([(0.2, n // 4, n // 2), (0.8, n - n // 4, n - n // 2)], "score double, pos long, neg long")
    old, E.score_counts = E.score_counts, lambda *a: sc
    try:
        assert E.auc(sc).first()["auc"] == 0.625
    finally:
        E.score_counts = old


def test_auc_and_roc_without_scores(spark):
    from custlens.operators import evaluation as E
    empty = spark.createDataFrame([], "label int, score double")
    assert E.auc(empty).first()["auc"] is None
    assert E.roc_curve(empty).count() == 1
    nan = spark.createDataFrame([(1, float("nan")), (0, float("nan"))], "label int, score double")
    assert E.auc(nan).first()["auc"] == 0.5


def test_brief_of_large_revenue(spark):
    from custlens.operators import segments as G
    df = spark.createDataFrame([("Loyal", 1, 2, 9e14)] * 3, "segment_name string, recency long, frequency long, monetary double")
    assert "Average Spend: $900000000000000.00" in G.segment_brief(df).first()["brief"]


def test_hot_customer_split_quota(spark):
    # one customer class holds most rows: quotas stay exact, ranks are spread over hash ranges
    n = 5000
    df = spark.range(n).select(F.col("id").alias("customer_id"),
                               (F.col("id") % 10 == 0).cast("int").alias("will_purchase"))
    s = L.stratified_split(df)
    agg = {(r["will_purchase"], r["is_test"]): r["count"] for r in s.groupBy("will_purchase", "is_test").count().collect()}
    assert agg[(0, True)] + agg[(1, True)] == math.ceil(0.2 * n)
    assert agg[(1, True)] == 100 and agg[(0, True)] == 900
    f = L.stratified_folds(df).groupBy("will_purchase", "fold").count().collect()
    sizes = {}
    for r in f:
        sizes.setdefault(r["will_purchase"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in np.random.default_rng(1).integers(0, 50, 997)] + [1e6, -3.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    from custlens.functions.quantiles import exact_quantile_row, exact_median_row
    q = exact_quantile_row(df, "v", [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0], list("abcdefg"), accuracy=100).first()
    assert list(q) == pytest.approx([float(np.quantile(vals, p)) for p in [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]], rel=0, abs=0)
    assert exact_median_row(df, "v").first()[0] == float(np.median(vals))


def test_grouped_quantiles_small_groups_match_numpy(spark):
    """Groups of 1..80 values (ties included): every quantile equals numpy's exactly."""
    import numpy as np
    from custlens.functions.quantiles import grouped_quantiles
    rng = np.random.default_rng(7)
    data, expect = [], {}
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for g in range(1, 81):
        vals = [float(x) for x in rng.integers(0, 20, g)] if g % 2 else [float(x) for x in rng.normal(size=g)]
        data += [(g, v) for v in vals]
        expect[g] = [float(np.quantile(vals, p)) for p in probs] + [float(np.median(vals))]
    df = spark.createDataFrame(data, "g int, v double")
    names = [f"q{i}" for i in range(len(probs))]
    lin = {r["group_key"]: [r[n] for n in names] for r in grouped_quantiles(df, "g", "v", probs, names).collect()}
    med = {r["group_key"]: r["m"] for r in grouped_quantiles(df, "g", "v", [0.5], ["m"], method="midpoint").collect()}
    for g, want in expect.items():
        assert lin[g] == want[:-1], g
        assert med[g] == want[-1], g


def test_block_gram_run_spanning_batches():
    # rows sorted by block pair; the (0, 1) run is split across two Arrow batches
    import numpy as np
    import pandas as pd
    rows = [(0, 0, [0, 1], [0, 1]), (0, 1, [0], [1]), (0, 1, [1], [0, 1]), (0, 1, [0, 1], [1]), (1, 1, [0, 1], [0, 1])]
    pdf = pd.DataFrame(rows, columns=["I", "J", "li", "lj"])
    pdf["li"] = pdf["li"].map(np.array)
    pdf["lj"] = pdf["lj"].map(np.array)
    out = pd.concat(A._block_gram_partials(2)([pdf.iloc[:2], pdf.iloc[2:]]))
    got = out.groupby(["a", "b"])["n"].sum().to_dict()
    # global index = block * 2 + local: (0,1) from block (0,0); (0,3) (1,2) (1,3) from (0,1); (2,3) from (1,1)
    assert got == {(0, 1): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1}
