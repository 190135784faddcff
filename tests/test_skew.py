"""A hot customer holding a third of all rows: results stay whole and equal a brute force."""

import datetime as dt
import itertools
from decimal import Decimal

import numpy as np
import pandas as pd

from custlens.operators import affinity as A
from custlens.operators import reports as R
from custlens.operators import rfm
from custlens.sources.tables import TRANSACTION_SCHEMA

CATS = ["A", "B", "C", "D", "E", "F"]


def _data(n=6000, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        cust = 1 if i % 3 == 0 else int(rng.integers(2, 400))
        d = dt.datetime(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 900)), seconds=int(rng.integers(0, 86400)))
        cents = int(rng.integers(1, 100000))
        rows.append((f"{i // 2}-{i % 2}", cust, d, CATS[int(rng.integers(0, 6))], 1, cents / 100,
                     Decimal(cents) / 100, "Cash"))
    return rows


def test_hot_customer_rfm_and_affinity(spark):
    rows = _data()
    df = spark.createDataFrame(rows, TRANSACTION_SCHEMA).repartition(8)
    pdf = pd.DataFrame(rows, columns=[f.name for f in TRANSACTION_SCHEMA.fields])
    got = {r["customer_id"]: r for r in rfm.rfm_table(df, checkpoint=False).collect()}
    ref = pdf["transaction_date"].max()
    for cid, g in pdf.groupby("customer_id"):
        r = got[cid]
        assert r["frequency"] == g["transaction_id"].nunique()
        assert r["monetary"] == float(sum(g["total_amount"]))
        assert r["recency"] == (ref - g["transaction_date"].max()).days + 1
        assert r["customer_lifetime_days"] == (g["transaction_date"].max() - g["transaction_date"].min()).days + 1
    assert got[1]["frequency"] == pdf[pdf.customer_id == 1]["transaction_id"].nunique()

    sets = pdf.groupby("customer_id")["product_category"].apply(set)
    want = {}
    for s in sets:
        for a, b in itertools.combinations(sorted(s), 2):
            want[(a, b)] = want.get((a, b), 0) + 1
    for aff_df in (A.category_affinity(df), A.category_affinity(df, 2, salts=4)):
        aff = {(r["category_a"], r["category_b"]): r["co_occurrence"] for r in aff_df.collect()}
        assert aff == want


def test_hot_customer_monthly_revenue(spark):
    rows = _data(seed=5)
    df = spark.createDataFrame(rows, TRANSACTION_SCHEMA).repartition(8)
    pdf = pd.DataFrame(rows, columns=[f.name for f in TRANSACTION_SCHEMA.fields])
    pdf["month"] = pdf["transaction_date"].dt.strftime("%Y-%m")
    want = pdf.groupby("month").agg(revenue=("total_amount", lambda s: float(sum(s))),
                                    transactions=("transaction_id", "count"),
                                    customers=("customer_id", "nunique"))
    got = {r["month"]: r for r in R.monthly_revenue(df).collect()}
    assert set(got) == set(want.index)
    for m, w in want.iterrows():
        assert (got[m]["revenue"], got[m]["transactions"], got[m]["customers"]) == (w["revenue"], w["transactions"], w["customers"])
