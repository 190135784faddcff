"""Registered queries: the RFM features."""

from __future__ import annotations

from custlens.operators import rfm
from custlens.plans.registry import register
from custlens.sources import tables as S

H = S.HISTORY_SQL


@register("rfm_table", rfm.rfm_sql(H))
def q_rfm_table(spark, sf_dir):
    return rfm.rfm_table(S.history(spark, sf_dir))


for _key, _feat in [
    ("rfm_recency", "recency"),
    ("rfm_frequency", "frequency"),
    ("rfm_monetary", "monetary"),
    ("rfm_avg_order_value", "avg_order_value"),
    ("rfm_lifetime", "customer_lifetime_days"),
    ("rfm_purchase_frequency", "purchase_frequency"),
    ("rfm_diversity", "product_diversity"),
]:
    def _q(spark, sf_dir, _feat=_feat):
        return rfm.rfm_feature(S.history(spark, sf_dir), _feat)
    register(_key, rfm.rfm_feature_sql(H, _feat))(_q)
