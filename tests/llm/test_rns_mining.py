import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.llm import rns_mining as R

DDL = "vec_id bigint, embedding array<float>, label int"


def vectors(n=420, width=9, seed=5, high=1.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.uniform(-0.3 * high, high) for _ in range(width)]
        if i % 5 == 0:
            v = [0.5 * high] * width        # copies: ties
        out.append((i, v, i % 4))
    return out


def brute(rows, every=100, positives=5, negatives=5):
    """All scores in Python integers; a row is its place in ``rows``."""
    used = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (vec_id, x, label) in enumerate(used):
        if vec_id is None or vec_id % every:
            continue
        score = [(sum(p * q for p, q in zip(x, y)), i, lab, b) for b, (i, y, lab) in enumerate(used)]
        same = sorted((s for s in score if s[2] == label and s[3] != a), key=order)[:positives]
        for s, i, _, _ in same:
            other = sorted((t for t in score if t[2] != label and 80 * s <= 100 * t[0] <= 100 * s), key=order)[:negatives]
            out += [(vec_id, i, r + 1, t[1], s, t[0]) for r, t in enumerate(other)]
    return sorted(out, key=repr)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    out = R.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_product_equals_integers():
    rng = np.random.default_rng(1)
    for width, high in ((1, 5), (64, 200), (3000, 1 << 20), (7, 1 << 29)):
        a, b = rng.integers(-high, high + 1, (5, width)), rng.integers(-high, high + 1, (6, width))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], dtype=object)
        primes = R.primes_for(max(abs(int(v)) for v in want.ravel()))
        got = R.scores([R.residues(a.astype(float), p) for p in primes], [R.residues(b.astype(float), p) for p in primes], primes)
        assert (got.astype(object) == want).all()


def test_balanced_ends():
    primes = R.primes_for(3)
    half = (math.prod(primes) - 1) // 2
    for v in (half, -half, 0, 1, -1):
        a, b = np.array([[float(v)]]), np.array([[1.0]])
        assert R.scores([R.residues(a, p) for p in primes], [R.residues(b, p) for p in primes], primes)[0, 0] == v


@pytest.mark.parametrize("blocks", [1 << 18, 300])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(R, "BLOCK_COMPONENTS", blocks)
    monkeypatch.setattr(R, "SHEET_COMPONENTS", 20)
    rows = vectors()
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 20


def test_odd_rows(spark):
    rows = vectors(210, 4)
    rows += [(100, rows[100][1], 0), (0, None, 1), (200, [0.1, None], 0), (300, [float("nan")], 1), (400, [float("inf"), 1.0], 2),
             (500, [], 3), (600, [0.2] * 9, 1), (None, [0.5] * 4, 0), (None, [0.5] * 4, 1), (700, [0.4, 0.4], None), (800, [-5.0] * 4, 2)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert any(r[0] == r[1] == 100 for r in got) or sum(r[0] == 100 for r in got)   # copies of an anchor are rows of their own


def test_large_components(spark):
    rows = vectors(130, 6, high=3.0e5)
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        mined(spark, [(0, [3.0e30], 1), (1, [1.0], 1)])


def test_empty_and_clashing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    df = spark.createDataFrame(vectors(), DDL)
    plain = sorted(tuple(r) for r in R.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    extra = df.withColumns({c: F.lit(i) for i, c in enumerate(["row", "x", "block", "sheet", "score", "anchor", "turn", "rank", "low", "high"])})
    assert sorted(tuple(r) for r in R.hard_negatives(extra, F.col("vec_id") % 100 == 0).collect()) == plain


def test_relabelled_query(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in R.op13(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute([(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows])
