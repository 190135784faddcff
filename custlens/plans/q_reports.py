"""Registered queries: reports, affinity, paging."""

from __future__ import annotations

from custlens.operators import affinity as A
from custlens.operators import affinity_bitmaps as AB
from custlens.operators import reports as R
from custlens.operators import rfm
from custlens.plans.registry import register
from custlens.sources.feature_store import history_table, page_index, rfm_features
from custlens.sources import pages
from custlens.sources import tables as S

H = S.HISTORY_SQL
RFM = rfm.rfm_sql(H)
RFM_SCALES = {"customer_id": 0, "recency": 0, "frequency": 0, "monetary": 2, "avg_order_value": 2,
              "customer_lifetime_days": 0, "purchase_frequency": 3, "product_diversity": 3}
PAGE_LIMIT, PAGE_OFFSET = 100, 100
DEEP_RFM, DEEP_TX = 1_250, 59_950   # offsets deep in the tables of scale 0.01; the second page lies across two ranges


def _rfm(spark, sf_dir):
    return rfm_features(spark, sf_dir, "history")


@register("dataset_summary", R.dataset_summary_sql(H, RFM))
def q_dataset_summary(spark, sf_dir):
    return R.dataset_summary(history_table(spark, sf_dir), _rfm(spark, sf_dir))


@register("rfm_statistics", R.rfm_statistics_sql(RFM))
def q_rfm_statistics(spark, sf_dir):
    return R.rfm_statistics(_rfm(spark, sf_dir))


@register("category_distribution", R.value_distribution_sql(H, "product_category", "product_category"))
def q_category_distribution(spark, sf_dir):
    return R.value_distribution(history_table(spark, sf_dir), "product_category", "product_category")


@register("payment_distribution", R.value_distribution_sql(H, "payment_method", "payment_method"))
def q_payment_distribution(spark, sf_dir):
    return R.value_distribution(history_table(spark, sf_dir), "payment_method", "payment_method")


@register("monthly_revenue", R.monthly_revenue_sql(H))
def q_monthly_revenue(spark, sf_dir):
    return R.monthly_revenue(history_table(spark, sf_dir))


@register("describe_rfm", R.describe_columns_sql(RFM, list(RFM_SCALES), RFM_SCALES))
def q_describe_rfm(spark, sf_dir):
    return R.describe_columns(_rfm(spark, sf_dir), list(RFM_SCALES), RFM_SCALES)


@register("rfm_histogram", R.histogram_sql(RFM, ["recency", "frequency", "monetary"]))
def q_rfm_histogram(spark, sf_dir):
    return R.histogram(_rfm(spark, sf_dir), ["recency", "frequency", "monetary"])


@register("max_transaction_number", R.max_transaction_number_sql(H))
def q_max_transaction_number(spark, sf_dir):
    return R.max_transaction_number(history_table(spark, sf_dir))


@register("distinct_values", R.distinct_values_sql(H))
def q_distinct_values(spark, sf_dir):
    return R.distinct_values(history_table(spark, sf_dir))


@register("page_rfm", R.page_sql(RFM, "customer_id", PAGE_LIMIT, PAGE_OFFSET))
def q_page_rfm(spark, sf_dir):
    return R.page_rfm(_rfm(spark, sf_dir), PAGE_LIMIT, PAGE_OFFSET)


@register("page_transactions", R.page_transactions_sql(H, PAGE_LIMIT, 0))
def q_page_transactions(spark, sf_dir):
    return R.page_transactions(history_table(spark, sf_dir), PAGE_LIMIT, 0)


@register("page_rfm_deep", R.page_sql(RFM, "customer_id", PAGE_LIMIT, DEEP_RFM))
def q_page_rfm_deep(spark, sf_dir):
    """F2 from the page index: only the ranges that the page overlaps are read."""
    return pages.page(page_index(spark, sf_dir, "rfm"), PAGE_LIMIT, DEEP_RFM)


@register("page_transactions_deep", R.page_transactions_sql(H, PAGE_LIMIT, DEEP_TX))
def q_page_transactions_deep(spark, sf_dir):
    return R.shown_transactions(pages.page(page_index(spark, sf_dir, "transactions"), PAGE_LIMIT, DEEP_TX))


@register("category_affinity", A.category_affinity_sql(H))
def q_category_affinity(spark, sf_dir):
    return AB.category_affinity(history_table(spark, sf_dir))


@register("affinity_top20", A.affinity_top_sql(H))
def q_affinity_top20(spark, sf_dir):
    return AB.affinity_top(history_table(spark, sf_dir))


@register("category_axis", A.category_axis_sql(H))
def q_category_axis(spark, sf_dir):
    return A.category_axis(AB.affinity_top(history_table(spark, sf_dir)))


@register("affinity_matrix", A.affinity_matrix_sql(H))
def q_affinity_matrix(spark, sf_dir):
    return A.affinity_matrix(AB.affinity_top(history_table(spark, sf_dir)))
