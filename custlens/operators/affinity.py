"""Category affinity (C1, F1) and its matrix views.

The literal form joins every transaction of a customer with every other one and then
counts distinct customers per category pair: O(rows per customer ^ 2), which a customer
holding a third of all rows makes impossible.  Here no pair row is ever emitted per customer.

The count for a pair (a, b) is the entry (a, b) of X^T X, where X is the customer x category
0/1 matrix.  It is built in blocks, by one path for any number of categories:

1. categories get an exact dense index without the driver (hash ranks), cut into blocks of
   ``BLOCK`` indices;
2. each customer has one set of local indices per block it touches (``collect_set`` with partial
   aggregation: at most ``BLOCK`` small integers, so a customer holding a third of all rows is
   pre-merged map-side and no set grows with the number of categories);
3. a customer's blocks are paired with each other (an equi-join on the customer; with up to
   ``BLOCK`` categories that is one row per customer), never its categories;
4. rows are shuffled by (block pair, salt), so a hot block pair is spread over many tasks; a task
   sorts them by block pair, holds one B x B matrix at a time (NumPy, Arrow batches) and emits its
   non-zero counts;
5. the partial counts are summed per pair and named.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens import constants as K

BLOCK = 512        # a B x B int64 matrix per task: 2 MiB
BLOCK_SALTS = 32   # tasks a single block pair is spread over
_CHUNK_ROWS = 4096  # customers per dense block inside a task


def _known(hist: DataFrame) -> DataFrame:
    return hist.where(F.col("customer_id").isNotNull() & F.col("product_category").isNotNull())


def _indicator(sets, k: int) -> np.ndarray:
    """0/1 matrix (rows = customers) of index sets in [0, k)."""
    lens = np.fromiter((len(c) for c in sets), dtype=np.int64, count=len(sets))
    x = np.zeros((len(sets), k), dtype=np.float32)
    if lens.sum():
        x[np.repeat(np.arange(len(sets)), lens), np.concatenate(list(sets)).astype(np.int64)] = 1.0
    return x


def _block_gram_partials(block: int):
    """mapInPandas body over rows (I, J, li, lj) sorted by (I, J): per run of one block pair,
    the sum of x_I x_J^T, emitted as global (a, b, n) rows with a < b, n > 0."""
    def flush(key, g):
        i, j = key
        a, b = np.triu_indices(block, 1) if i == j else np.indices((block, block)).reshape(2, -1)
        n = g[a, b]
        nz = n > 0
        return pd.DataFrame({"a": (i * block + a[nz]).astype(np.int32),
                             "b": (j * block + b[nz]).astype(np.int32), "n": n[nz]})

    def run(batches):
        key, g = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            bi, bj = pdf["I"].to_numpy(), pdf["J"].to_numpy()
            cut = np.flatnonzero((bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            li, lj = pdf["li"].to_numpy(), pdf["lj"].to_numpy()
            for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(pdf)]])):
                k = (int(bi[s]), int(bj[s]))
                if k != key:
                    if key is not None:
                        yield flush(key, g)
                    key, g = k, np.zeros((block, block), dtype=np.int64)
                for lo in range(s, e, _CHUNK_ROWS):
                    hi = min(lo + _CHUNK_ROWS, e)
                    g += (_indicator(li[lo:hi], block).T @ _indicator(lj[lo:hi], block)).astype(np.int64)
        if key is not None:
            yield flush(key, g)
    return run


def category_affinity(hist: DataFrame, block: int = BLOCK, salts: int = BLOCK_SALTS) -> DataFrame:
    """(category_a, category_b, co_occurrence) for every pair with a < b seen together."""
    from custlens.functions.ranking import hash_rank_within
    cats = _known(hist).select("product_category").distinct().withColumn("_g", F.lit(0))
    idx = hash_rank_within(cats, "_g", F.xxhash64("product_category"), tiebreak="product_category") \
        .select(F.col("rank").cast("int").alias("ci"), "product_category")
    sets = (_known(hist).select("customer_id", "product_category").join(idx, "product_category")
                        .select("customer_id", F.floor(F.col("ci") / F.lit(block)).cast("int").alias("I"), F.pmod("ci", F.lit(block)).alias("l"))
                        .groupBy("customer_id", "I").agg(F.collect_set("l").alias("li")))
    other = sets.select("customer_id", F.col("I").alias("J"), F.col("li").alias("lj"))
    rows = sets.join(other, "customer_id").where("I < J or (I = J and size(li) >= 2)")
    salted = (rows.withColumn("_s", F.pmod(F.xxhash64("customer_id"), F.lit(salts)))
                  .repartition("I", "J", "_s").sortWithinPartitions("I", "J"))
    partial = salted.select("I", "J", "li", "lj").mapInPandas(_block_gram_partials(block), "a int, b int, n long")
    counts = partial.groupBy("a", "b").agg(F.sum("n").alias("n"))
    na = idx.select(F.col("ci").alias("a"), F.col("product_category").alias("name_a"))
    nb = idx.select(F.col("ci").alias("b"), F.col("product_category").alias("name_b"))
    # the index is in hash order: name each pair in category order
    return (counts.join(na, "a").join(nb, "b")
                  .select(F.least("name_a", "name_b").alias("category_a"),
                          F.greatest("name_a", "name_b").alias("category_b"),
                          F.col("n").alias("co_occurrence")))


def affinity_top(hist: DataFrame, n: int = K.AFFINITY_TOP) -> DataFrame:
    """the n most frequent pairs (ties broken by the pair names)."""
    return category_affinity(hist).orderBy(F.desc("co_occurrence"), "category_a", "category_b").limit(n)


def category_axis(top: DataFrame) -> DataFrame:
    """Sorted distinct union of both pair columns, with its position."""
    cats = (top.select(F.col("category_a").alias("category"))
               .union(top.select(F.col("category_b").alias("category"))).distinct())
    # the axis comes from a top-n report, so it has at most 2n rows: a single ordered window is fine
    from pyspark.sql import Window
    return cats.withColumn("position", F.row_number().over(Window.orderBy("category")))


def affinity_matrix(top: DataFrame) -> DataFrame:
    """The symmetric category x category matrix in coordinate form (row, col, value);
    absent pairs and the diagonal are 0.  Bounded by the axis (<= 2n categories)."""
    axis = category_axis(top).agg(F.collect_list("category").alias("axis"))  # <= 2n values
    cells = axis.select(F.explode("axis").alias("row_category"), "axis") \
                .select("row_category", F.explode("axis").alias("col_category"))
    sym = (top.select(F.col("category_a").alias("row_category"), F.col("category_b").alias("col_category"),
                      "co_occurrence")
              .union(top.select("category_b", "category_a", "co_occurrence")))
    return (cells.join(sym, ["row_category", "col_category"], "left")
                 .select("row_category", "col_category",
                         F.coalesce(F.col("co_occurrence"), F.lit(0).cast("long")).alias("value")))


# ---------------------------------------------------------------- oracle SQL (the literal self-join)

def category_affinity_sql(hist_sql: str) -> str:
    return f"""
WITH t AS (SELECT * FROM ({hist_sql}) WHERE customer_id IS NOT NULL AND product_category IS NOT NULL)
SELECT t1.product_category AS category_a, t2.product_category AS category_b,
       COUNT(DISTINCT t1.customer_id) AS co_occurrence
FROM t t1 JOIN t t2 ON t1.customer_id = t2.customer_id
WHERE t1.product_category < t2.product_category
GROUP BY t1.product_category, t2.product_category"""


def affinity_top_sql(hist_sql: str, n: int = K.AFFINITY_TOP) -> str:
    return f"SELECT * FROM ({category_affinity_sql(hist_sql)}) ORDER BY co_occurrence DESC, category_a, category_b LIMIT {n}"


def category_axis_sql(hist_sql: str) -> str:
    return f"""
SELECT category, CAST(ROW_NUMBER() OVER (ORDER BY category) AS INTEGER) AS position FROM (
  SELECT category_a AS category FROM ({affinity_top_sql(hist_sql)})
  UNION SELECT category_b FROM ({affinity_top_sql(hist_sql)}))"""


def affinity_matrix_sql(hist_sql: str) -> str:
    return f"""
WITH top AS ({affinity_top_sql(hist_sql)}),
axis AS (SELECT category_a AS c FROM top UNION SELECT category_b FROM top),
sym AS (SELECT category_a AS r, category_b AS c, co_occurrence AS v FROM top
        UNION ALL SELECT category_b, category_a, co_occurrence FROM top)
SELECT a1.c AS row_category, a2.c AS col_category, COALESCE(sym.v, 0) AS value
FROM axis a1 CROSS JOIN axis a2 LEFT JOIN sym ON sym.r = a1.c AND sym.c = a2.c"""
