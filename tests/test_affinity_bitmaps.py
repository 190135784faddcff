"""Category affinity on bitmaps: equal to the literal pairs at any width, number of chunks and of categories."""

import collections
import itertools
import random

import pytest

from custlens.operators import affinity as A
from custlens.operators import affinity_bitmaps as B
from custlens.sources import tables as S
from tests.conftest import SF_SMALL

SCHEMA = "customer_id long, product_category string"


def baskets_of(categories, customers, most, seed):
    rng = random.Random(seed)
    return {c: {f"c{rng.randrange(categories):04d}" for _ in range(rng.randint(1, most))} for c in range(customers)}


def frame(spark, baskets):
    return spark.createDataFrame([(c, x) for c, s in baskets.items() for x in s], SCHEMA)


def literal(baskets):
    return collections.Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))


def got(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len({r[:2] for r in out})
    return {r[:2]: r[2] for r in out}


@pytest.mark.parametrize("categories", [6, 600, 5000])
def test_any_number_of_categories(spark, categories):
    baskets = baskets_of(categories, 400, 9, categories)
    assert got(B.category_affinity(frame(spark, baskets))) == literal(baskets)


@pytest.mark.parametrize("words, chunks", [(1, 1), (1, 3), (4, 1), (16, 1), (16, 40)])
def test_any_width_and_number_of_chunks(spark, words, chunks):
    """One chunk of 64-bit bitmaps for 700 customers: all but the first part are overflow."""
    baskets = baskets_of(20, 700, 12, 5)
    assert got(B.category_affinity(frame(spark, baskets), words, chunks)) == literal(baskets)


def test_hot_customer_repeats_nulls_and_extremes(spark):
    """A customer with a third of all rows, repeated rows, null keys, the ends of the id range, odd names."""
    rows = [(7, f"k{i % 5}") for i in range(3000)] + [(c, f"k{c % 3}") for c in range(-3000, 3000)]
    rows += [(None, "k1"), (None, "k2"), (9000, None), (9000, "k1"), (9000, "k1"),
             (-2**63, "k1"), (-2**63, ""), (2**63 - 1, "k1"), (2**63 - 1, "é"), (2**63 - 1, "")]
    sets = collections.defaultdict(set)
    for c, x in rows:
        if c is not None and x is not None:
            sets[c].add(x)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    for words in B.WORDS:
        assert got(B.category_affinity(df, words)) == literal(sets)


def test_empty_and_single(spark):
    assert B.category_affinity(spark.createDataFrame([], SCHEMA)).count() == 0
    assert B.category_affinity(spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], SCHEMA)).count() == 0


def test_equals_the_block_products(spark):
    hist = S.history(spark, SF_SMALL)
    assert got(B.category_affinity(hist)) == got(A.category_affinity(hist))


def test_stays_on_the_jvm_and_joins_bitmaps_by_chunk(spark):
    p = B.category_affinity(S.history(spark, SF_SMALL), 16, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert "partial_sum" in p   # counts are summed before they are shuffled


def test_rare_categories_take_narrow_bitmaps():
    assert min(B.WORDS, key=lambda w: B.join_cost(10**9, 6, 4 * 10**9, w)) == 16
    assert min(B.WORDS, key=lambda w: B.join_cost(10**9, 100_000, 2 * 10**9, w)) == 1
