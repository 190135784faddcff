"""Cutting lineage safely.

``materialize`` writes the frame as a Parquet table into the shared folder named by
``spark.checkpoint.dir`` and reads it back: one job computes it (an eager RDD checkpoint would
compute an uncached plan twice), the copy survives executor loss, and later reads get column
pruning and filter pushdown.  The copy goes when the session ends.  Never a local checkpoint or a machine-local folder.
Use it where one intermediate result feeds several consumers (scalar subqueries + main plan,
iterative ML) and recomputing its input would repeat large joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from custlens.session import delete_at_exit, scratch_path


def materialize(df: DataFrame, name: str = "mat") -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.parquet(path)
