"""Registered queries: scaling, assignment, cost, silhouette and segment reports
(B5, B8, B9, B12, D11, D12, D16, D19, E1, F4, G4, H1, H4, H5, H6).

They run on the deterministic segmentation (recency bins -> centres -> nearest centre), which
SQL reproduces; K-Means itself (H2, H3, H7) is registered in ``q_models``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from custlens import constants as K
from custlens.operators import predicates as P
from custlens.operators import rfm
from custlens.operators import segments as G
from custlens.plans import silhouette
from custlens.plans.blocks import pack
from custlens.plans.registry import register
from custlens.sources.feature_store import given_segments, rfm_features
from custlens.sources import tables as S

H = S.HISTORY_SQL
RFM = rfm.rfm_sql(H)
KG = 6  # clusters of the deterministic segmentation
SEG = G.given_segmentation_sql(RFM, KG)
DETAIL_SEGMENT = 0
Z = G.Z


def _rfm(spark, sf_dir):
    return rfm_features(spark, sf_dir, "history")


def _named(spark, sf_dir):
    """The stored, named segment assignment (reports read it like the reference's stored
    segment columns); H1 and H4-H6 below compute from the features."""
    return given_segments(spark, sf_dir, KG), None


@register("standardize", f"SELECT customer_id, {', '.join(f'ROUND({c}, 9) AS {c}' for c in Z)} FROM ({SEG['z']})")
def q_standardize(spark, sf_dir):
    z = G.standardize_lazy(_rfm(spark, sf_dir))
    return z.select("customer_id", *[F.round(c, 9).alias(c) for c in Z])


@register("segment_assign", f"SELECT customer_id, segment, ROUND(distance, 9) AS distance, confidence FROM ({SEG['assigned']})")
def q_segment_assign(spark, sf_dir):
    a, _ = G.given_segmentation(_rfm(spark, sf_dir), KG)
    return a.select("customer_id", "segment", F.round("distance", 9).alias("distance"), "confidence")


_D2 = " + ".join(f"(b.{c} - c.c_{c}) * (b.{c} - c.c_{c})" for c in Z)


@register("cluster_inertia", f"SELECT ROUND(SUM({_D2}), 6) AS inertia FROM ({SEG['binned']}) b "
                             f"JOIN ({SEG['centres']}) c ON b.segment = c.cid")
def q_cluster_inertia(spark, sf_dir):
    binned = G.bin_clusters(G.standardize_lazy(_rfm(spark, sf_dir)), KG)
    cents = G.centres_list(G.cluster_centres(binned))
    return G.inertia(binned, cents).select(F.round("inertia", 6).alias("inertia"))


def _assigned(spark, sf_dir):
    """The stored assignment (H6 output); H4, D19, E1 and B8 are operators on an assignment."""
    return given_segments(spark, sf_dir, KG).drop("segment_name")


@register("silhouette", G.silhouette_sql(SEG["assigned"]))
def q_silhouette(spark, sf_dir):
    return G.silhouette(_assigned(spark, sf_dir)).select(F.round("silhouette", 9).alias("silhouette"))


@register("silhouette_euclidean", G.euclidean_silhouette_sql(SEG["assigned"]))
def q_silhouette_euclidean(spark, sf_dir):
    """H4 in the plain form, from all pairs of customers."""
    assigned, centres = G.given_segmentation(_rfm(spark, sf_dir), KG)
    (value, _), = silhouette.euclidean(pack(assigned, "customer_id", Z), assigned, Z, [np.array([c for _, c in centres])])
    return spark.createDataFrame([(round(value, 9),)], "silhouette double")


@register("segment_score", SEG["scores"])
def q_segment_score(spark, sf_dir):
    return G.segment_scores(_assigned(spark, sf_dir))


@register("segment_ranking", SEG["ranked"])
def q_segment_ranking(spark, sf_dir):
    return G.segment_ranking(G.segment_scores(_assigned(spark, sf_dir)), KG)


@register("segment_name_lookup", f"""SELECT a.customer_id, a.segment,
    COALESCE(r.segment_name, 'Segment ' || CAST(a.segment AS VARCHAR)) AS segment_name
    FROM ({SEG['assigned']}) a LEFT JOIN (SELECT * FROM ({SEG['ranked']}) WHERE rank > 0) r USING (segment)""")
def q_segment_name_lookup(spark, sf_dir):
    """The mapping lacks the first segment, whose customers get the fallback name."""
    a = _assigned(spark, sf_dir)
    mapping = G.segment_ranking(G.segment_scores(a), KG).where("rank > 0")
    return P.segment_name_lookup(a.select("customer_id", "segment"), mapping, fallback=True)


@register("recommendation_lookup", f"""SELECT customer_id, segment_name, {P.recommendation_sql('segment_name')} AS recommendation
    FROM ({SEG['named']})""")
def q_recommendation_lookup(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return named.select("customer_id", "segment_name", P.recommendation_for("segment_name").alias("recommendation"))


@register("segment_profile", G.segment_profile_sql(SEG["named"]))
def q_segment_profile(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return G.segment_profile(named)


@register("segment_detail", G.segment_detail_sql(SEG["named"], DETAIL_SEGMENT))
def q_segment_detail(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return G.segment_detail(named, DETAIL_SEGMENT)


@register("segment_distribution", G.segment_distribution_sql(SEG["named"]))
def q_segment_distribution(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return G.segment_distribution(named)


_MEMBER_COLS = ["customer_id", "segment", "segment_name", "recency", "frequency", "monetary"]


@register("segment_filter", f"SELECT {', '.join(_MEMBER_COLS)} FROM ({SEG['named']}) WHERE segment = {DETAIL_SEGMENT}")
def q_segment_filter(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return G.segment_filter(named, DETAIL_SEGMENT).select(*_MEMBER_COLS)


@register("segment_members", f"SELECT {', '.join(_MEMBER_COLS)} FROM ({SEG['named']}) WHERE segment = {DETAIL_SEGMENT} "
                             f"ORDER BY customer_id LIMIT {K.SEGMENT_MEMBERS_SHOWN}")
def q_segment_members(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return G.segment_members(named, DETAIL_SEGMENT).select(*_MEMBER_COLS)


@register("segment_brief", G.segment_brief_sql(SEG["named"]))
def q_segment_brief(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return G.segment_brief(named)


@register("segment_metric_matrix", G.segment_metric_matrix_sql(G.segment_profile_sql(SEG["named"])))
def q_segment_metric_matrix(spark, sf_dir):
    named, _ = _named(spark, sf_dir)
    return G.segment_metric_matrix(G.segment_profile(named))
