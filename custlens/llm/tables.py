"""Reading the given tables and writing intermediate ones to the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custlens.session import delete_at_exit, scratch_path


DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NARROW = 8
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver did (clusters install it, or ship it
    with --py-files)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, env.get("PYTHONPATH"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but those of ``documents`` under a neutral name, so that an
    operator's own columns never clash with them; and what gives a result its columns back."""
    names = docs.columns
    safe = [c if c in DOCUMENT_COLUMNS else f"extra{i}" for i, c in enumerate(names)]
    return docs.toDF(*safe), lambda out: out.select(*safe).toDF(*names)


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once under the shared folder (``spark.checkpoint.dir``) and read it back:
    several consumers share one computation and a lost executor re-reads the files.  It goes when
    the session ends.  ``narrow``: rows of a few numbers, made from such rows, go to an eighth of
    the usual files."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    if narrow:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(schema).parquet(path)
