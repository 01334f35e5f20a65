"""The query catalogue: importing the ``q_*`` modules registers every named query and oracle."""

from __future__ import annotations

from riskmart.plans import q_boosting, q_features, q_monitoring, q_metrics, q_prep, q_quality, q_scoring, q_training  # noqa: F401
from riskmart.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
