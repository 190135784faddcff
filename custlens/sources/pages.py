"""Paging far into a table (F2, F3): a page index of key ranges.

The table is written once in ranges of its order, about ``ROWS_PER_RANGE`` rows each; the index has one
row per range with its row count and the rows before it.  A page reads the ranges that it
overlaps, one or two for a usual page, whatever its offset, and the total comes from the index.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.functions.materialize import materialize
from custlens.operators.reports import check_page
from custlens.session import delete_at_exit, scratch_path

ROWS_PER_RANGE = 20_000
RANGE = "_range"


@dataclass
class PageIndex:
    table: DataFrame                    # rows and their range
    index: DataFrame                    # range, n, before
    order: Callable[[], list[Column]]   # a total order


def build_page_index(df: DataFrame, order: Callable[[], list[Column]], rows_per_range: int = ROWS_PER_RANGE) -> PageIndex:
    spark = df.sparkSession
    n_ranges = max(1, -(-df.count() // rows_per_range))
    path = scratch_path(spark, "pages")
    ranged = df.repartitionByRange(n_ranges, *order()).withColumn(RANGE, F.spark_partition_id())
    ranged.write.partitionBy(RANGE).parquet(path)
    delete_at_exit(spark, path)
    table = spark.read.schema(ranged.schema).parquet(path)
    counts = table.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)   # over one row per range
    index = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return PageIndex(table, materialize(index.coalesce(1), "page-index"), order)


def page(pages: PageIndex, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit - 1 in the index's order, plus the total row count."""
    check_page(limit, offset)
    inside = pages.index.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    found = inside.orderBy(RANGE).collect()   # as many as a page overlaps
    total = pages.index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = pages.table.where(F.col(RANGE).isin([r[RANGE] for r in found])) if found else pages.table.where("false")
    skip = offset - found[0]["before"] if found else 0
    return rows.orderBy(*pages.order()).offset(skip).limit(limit).drop(RANGE).withColumn("total", F.lit(total).cast("long"))
