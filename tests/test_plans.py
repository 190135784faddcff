"""Plan shape: filters and column pruning reach the scans, no cartesian products, no
single-partition windows over customer-sized data."""

from custlens.operators import affinity as A
from custlens.operators import rfm
from custlens.sources import tables as S
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_live_filter_pushed(spark):
    p = plan(S.live_purchases(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_transactions_prune_columns(spark):
    p = plan(S.transactions(spark, SF_SMALL))
    assert "l_comment" not in p and "l_shipdate" not in p and "p_name" not in p


def test_affinity_has_no_cartesian(spark):
    p = plan(A.category_affinity(S.history(spark, SF_SMALL)))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_affinity_shuffles_by_salted_block_pair(spark):
    p = plan(A.category_affinity(S.history(spark, SF_SMALL), 2, salts=4))
    assert "hashpartitioning(I#" in p and "MapInPandas" in p and "Generate" not in p
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_quantiles_neither_join_nor_shuffle_values_by_group(spark):
    from pyspark.sql import functions as F

    from custlens.functions.quantiles import exact_quantile_row, grouped_quantiles
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 1.5).alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in (exact_quantile_row(df, "v", [0.25, 0.5], ["a", "b"]), grouped_quantiles(df, "g", "v", [0.25, 0.5], ["a", "b"])):
            p = plan(q)
            assert "CartesianProduct" not in p and "NestedLoopJoin" not in p and "SortMergeJoin" not in p
            assert q.count() in (1, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rfm_no_global_window(spark):
    p = plan(rfm.rfm_table(S.history(spark, SF_SMALL), checkpoint=False))
    assert "Window" not in p and "CartesianProduct" not in p


def test_layout_needs_no_exchange_on_the_customer(spark):
    from custlens.sources.feature_store import history_table
    from custlens.sources.files import customer_layout
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with customer_layout(spark, {"tx": history_table(spark, SF_SMALL)}) as t:
            assert "Exchange" not in plan(rfm.customer_aggregates(t["tx"], in_place=True))
            tables = [x.name for x in spark.catalog.listTables()]
            assert any(n.startswith("tx_by_customer_") for n in tables)
        assert not any(x.name.startswith("tx_by_customer_") for x in spark.catalog.listTables())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
