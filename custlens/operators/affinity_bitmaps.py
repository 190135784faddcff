"""Category affinity (C1) on bitmaps of customers, on the JVM alone.

Customers are dealt to chunks by hash and numbered inside their chunk.  A category's customers of
one chunk are then one bitmap of ``words`` longs, and the customers that two categories share are the
bit counts of their conjunction, summed over the chunks: a join of the bitmaps of a chunk with each
other, whose rows stand for up to ``64 * words`` customers each and are summed before the shuffle.

Plan at scale: (customer, category) is made distinct with map-side aggregation, so a customer holding
a third of all rows counts as at most one row per category afterwards.  A chunk holds a bounded number
of customers, and of each category one bitmap, so no key grows with the data; more data are more
chunks.  No Python worker takes part, and the inner loop is generated code.

``words`` only steers the cost (a wide bitmap pays where categories are common among customers, a
narrow one where they are rare); it is chosen from approximate counts, and any value gives the same rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens import constants as K

WORD = 64
WORDS = (1, 4, 16)
FILL = 0.8   # of a chunk's places, on average; customers beyond the last place go to a further part


def join_cost(customers: int, categories: int, entries: int, words: int) -> float:
    """Estimated pairs of bitmaps, each weighted by its width."""
    size = WORD * words
    density = min(1.0, entries / max(1, customers * categories))
    present = categories * (1 - (1 - density) ** size)   # of the categories, in a chunk
    return customers / size * present**2 * (1 + words / 8)


def _sizes(known: DataFrame) -> tuple[int, int, int]:
    """Approximate numbers of customers, categories and (customer, category) entries."""
    row = known.agg(F.approx_count_distinct("customer_id").alias("c"), F.approx_count_distinct("product_category").alias("k"),
                    F.approx_count_distinct(F.xxhash64("customer_id", "product_category")).alias("e")).first()
    return row["c"], row["k"], row["e"]


def category_bitmaps(hist: DataFrame, words: int, chunks: int) -> DataFrame:
    """``chunk, part, category, m0 ..``: the customers of a category, as bits."""
    size = WORD * words
    entries = (hist.where(F.col("customer_id").isNotNull() & F.col("product_category").isNotNull())
                   .select("customer_id", F.col("product_category").alias("category")).distinct()
                   .withColumn("chunk", F.pmod(F.xxhash64("customer_id"), F.lit(chunks))))
    place = F.dense_rank().over(Window.partitionBy("chunk").orderBy("customer_id")) - 1
    placed = entries.withColumn("place", place).select(
        "chunk", "category", F.expr(f"place div {size}").alias("part"),
        F.expr(f"place % {size} div {WORD}").alias("word"),
        F.expr(f"shiftleft(1L, cast(place % {WORD} as int))").alias("bit"))
    masks = [F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(words)]
    return placed.groupBy("chunk", "part", "category").agg(*masks)


def category_affinity(hist: DataFrame, words: int | None = None, chunks: int | None = None) -> DataFrame:
    """(category_a, category_b, co_occurrence) for every pair with a < b seen together."""
    if words is None or chunks is None:
        customers, categories, entries = _sizes(hist.where("customer_id is not null and product_category is not null"))
        words = words or min(WORDS, key=lambda w: join_cost(customers, categories, entries, w))
        chunks = chunks or max(1, round(customers / (WORD * words * FILL)))
    maps = category_bitmaps(hist, words, chunks)
    a, b = maps.alias("a"), maps.alias("b")
    both = a.join(b, (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.category") < F.col("b.category")))
    shared = reduce(add, [F.bit_count(F.col(f"a.m{i}").bitwiseAND(F.col(f"b.m{i}"))) for i in range(words)])
    return (both.groupBy(F.col("a.category").alias("category_a"), F.col("b.category").alias("category_b"))
                .agg(F.sum(shared).alias("co_occurrence")).where("co_occurrence > 0"))


def affinity_top(hist: DataFrame, n: int = K.AFFINITY_TOP) -> DataFrame:
    """the n most frequent pairs (ties broken by the pair names)."""
    return category_affinity(hist).orderBy(F.desc("co_occurrence"), "category_a", "category_b").limit(n)
