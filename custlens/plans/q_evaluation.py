"""Registered queries: label, split and evaluation.

Evaluation runs on the rule label (E3) against a closed-form score (frequency / max
frequency) so every curve and metric has a SQL oracle without a fitted model."""

from __future__ import annotations

from custlens.operators import evaluation as E
from custlens.operators import labels as L
from custlens.operators import rfm
from custlens.plans.registry import register
from custlens.sources.feature_store import rfm_features
from custlens.sources import tables as S

H = S.HISTORY_SQL
RFM = rfm.rfm_sql(H)
TARGET = L.purchase_target_sql(RFM)
SCORED = L.scored_customers_sql(RFM)


def _rfm(spark, sf_dir):
    return rfm_features(spark, sf_dir, "history")


def _scored(spark, sf_dir):
    return L.scored_customers(_rfm(spark, sf_dir))


@register("max_normalize", L.max_normalize_sql(RFM))
def q_max_normalize(spark, sf_dir):
    return L.max_normalize(_rfm(spark, sf_dir))


@register("purchase_target", TARGET)
def q_purchase_target(spark, sf_dir):
    return L.purchase_target(_rfm(spark, sf_dir))


@register("target_distribution", L.target_distribution_sql(TARGET))
def q_target_distribution(spark, sf_dir):
    return L.target_distribution(L.purchase_target(_rfm(spark, sf_dir)))


@register("stratified_split", L.stratified_split_sql(TARGET))
def q_stratified_split(spark, sf_dir):
    return L.stratified_split(L.purchase_target(_rfm(spark, sf_dir)))


@register("stratified_folds", L.stratified_folds_sql(TARGET))
def q_stratified_folds(spark, sf_dir):
    return L.stratified_folds(L.purchase_target(_rfm(spark, sf_dir)))


@register("roc_curve", E.roc_curve_sql(SCORED))
def q_roc_curve(spark, sf_dir):
    return E.roc_curve(_scored(spark, sf_dir))


@register("auc", E.auc_sql(SCORED))
def q_auc(spark, sf_dir):
    return E.auc(_scored(spark, sf_dir))


@register("confusion_matrix", E.confusion_matrix_sql(SCORED))
def q_confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_scored(spark, sf_dir))


@register("confusion_long", E.confusion_long_sql(E.confusion_matrix_sql(SCORED)))
def q_confusion_long(spark, sf_dir):
    return E.confusion_long(E.confusion_matrix(_scored(spark, sf_dir)))


@register("classification_metrics", E.classification_metrics_sql(SCORED))
def q_classification_metrics(spark, sf_dir):
    return E.classification_metrics(_scored(spark, sf_dir))
