"""The page index and the Euclidean silhouette."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.operators import reports as R
from custlens.plans import silhouette as S
from custlens.plans.blocks import pack
from custlens.sources.pages import build_page_index, page


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(2000).select((F.col("id") * 7919 % 2003).alias("key"), F.when(F.col("id") % 9 != 0, F.col("id") % 5).alias("grade")).repartition(5)


def test_pages_equal_the_sorted_table(table):
    order = lambda: [F.desc_nulls_last("grade"), F.col("key")]
    whole = [tuple(r) for r in table.orderBy(*order()).collect()]
    index = build_page_index(table, order, 100)
    assert index.index.count() > 10 and index.index.agg(F.sum("n")).first()[0] == 2000
    starts = [r["before"] for r in index.index.collect()]
    for limit, offset in [(10, 0), (100, 995), (1, 1999), (300, 1850), (10, 2000), (5, 10**6), (2000, 0), *((7, max(0, s - 3)) for s in starts[:4])]:
        got = page(index, limit, offset).collect()
        assert [tuple(r)[:2] for r in got] == whole[offset:offset + limit]
        assert all(r["total"] == 2000 for r in got)
    with pytest.raises(ValueError):
        page(index, 0, 0)


def test_a_deep_page_reads_its_ranges_only(table):
    index = build_page_index(table, lambda: [F.col("key")], 100)
    found = page(index, 20, 1500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_range" in plan
    ranges = re.search(r"PartitionFilters: \[[^\]]*?_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert 1 <= len((ranges.group(1) or ranges.group(2)).split(",")) <= 2


def test_pages_of_an_empty_table(table):
    index = build_page_index(table.where("false"), lambda: [F.col("key")])
    assert page(index, 10, 0).collect() == [] and page(index, 10, 50).collect() == []


def _exact(x, centres):
    label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(label):
        own = label == c
        others = [d[i][label == o].mean() for o in set(label) - {c}]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = d[i][own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_euclidean_silhouette(spark, monkeypatch):
    monkeypatch.setattr("custlens.plans.blocks.BLOCK_ROWS", 80)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.6, (110, 2)) for c in ((0, 0), (3, 1), (1, 4))] + [[[40.0, 40.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "customer_id long, a double, b double")
    blocks = pack(df, "customer_id", ["a", "b"])
    models = [np.array([[0, 0], [3, 1], [1, 4], [40, 40.0]]), np.array([[0, 0], [2, 3.0]]), np.array([[1, 1.0]]), np.array([[0, 0], [3, 1], [999, 999.0]])]
    want = [_exact(x, m) for m in models]
    assert S.euclidean(blocks, df, ["a", "b"], models) == [(pytest.approx(w, abs=1e-9), pytest.approx(0, abs=1e-9)) for w in want]
    for most in (150, 40):
        got = S.euclidean(blocks, df, ["a", "b"], models, most)
        assert all(abs(s - w) <= e + 1e-12 for (s, e), w in zip(got, want)) and 0 < got[0][1] < 1
        assert all(abs(s - w) < 0.05 for (s, _), w in zip(got, want))   # much nearer than the bound


def test_euclidean_silhouette_compares_all_pairs_of_many_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.8, (1600, 2)) for c in ((0, 0), (3, 1), (1, 4))])   # 4800 different rows
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "customer_id long, a double, b double")
    models = [np.array([[0, 0], [3, 1], [1, 4.0]]), np.array([[0, 0], [2, 3.0]])]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    want = []
    for m in models:
        label = ((x[:, None] - m) ** 2).sum(axis=2).argmin(axis=1)
        n = np.bincount(label)
        sums = np.stack([d[:, label == c].sum(axis=1) for c in range(len(m))], axis=1)
        a, mean = sums[np.arange(len(x)), label] / (n[label] - 1), sums / n
        mean[np.arange(len(x)), label] = np.inf
        b = mean.min(axis=1)
        want.append(((b - a) / np.maximum(a, b)).mean())
    got = S.euclidean(pack(df, "customer_id", ["a", "b"]), df, ["a", "b"], models)
    assert got == [(pytest.approx(w, abs=1e-12), 0.0) for w in want]


def test_euclidean_silhouette_in_chunks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr("custlens.plans.blocks.BLOCK_ROWS", 30)
    monkeypatch.setattr(S, "PIECE_ROWS", 20)
    monkeypatch.setattr(S, "CHUNK_BLOCKS", 2)   # several passes
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.6, (60, 2)) for c in ((0, 0), (3, 1))] + [[[2.0, 2.0]] * 40, [[40.0, 40.0]]])
    df = spark.createDataFrame([(i // 2, float(a), float(b)) for i, (a, b) in enumerate(x)], "customer_id long, a double, b double")
    models = [np.array([[0, 0], [3, 1], [40, 40.0]]), np.array([[1, 1.0]]), np.array([[0, 0], [3, 1], [999, 999.0]])]
    got = S.euclidean(pack(df, "customer_id", ["a", "b"]), df, ["a", "b"], models)
    assert got == [(pytest.approx(_exact(x, m), abs=1e-12), 0.0) for m in models]


def test_distances_of_near_rows_are_exact():
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(300, 7)), 50 + 1e-7 * rng.normal(size=(300, 7))))
    y = np.concatenate((x[::2], x[:300] + 1e-9))
    models = [x[[0, 1, 300]], x[[5]]]
    sums = np.zeros((len(x), 4))
    S._add_distances(sums, x, y, models)
    want = np.sqrt(((x[:, None] - y) ** 2).sum(axis=2)) @ S._members(y, models)
    assert np.allclose(sums, want, rtol=1e-12, atol=0)
    alone = np.zeros((300, 4))
    S._add_distances(alone, x[300:], x[300:], models)   # all distances are tiny
    assert np.allclose(alone, np.sqrt(((x[300:, None] - x[300:]) ** 2).sum(axis=2)) @ S._members(x[300:], models), rtol=1e-12, atol=0)


def test_page_checks():
    for limit, offset in [(0, 0), (10_001, 0), (1, -1)]:
        with pytest.raises(ValueError):
            R.check_page(limit, offset)
