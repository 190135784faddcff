"""Query plans: each module registers named queries with their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = [
    "custlens.plans.q_features",
    "custlens.plans.q_reports",
    "custlens.plans.q_predicates",
    "custlens.plans.q_evaluation",
    "custlens.plans.q_segments",
    "custlens.plans.q_sinks",
    "custlens.plans.q_streaming",
    "custlens.plans.q_models",
]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(m)
