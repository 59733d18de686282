"""Imports every query module, so that the registry is complete."""

from flowlab.plans import (  # noqa: F401
    q_audit,
    q_features,
    q_functions,
    q_ingest,
    q_metrics,
    q_models,
    q_runs,
    q_sampling,
    q_studies,
)
from flowlab.plans.registry import ORACLES, QUERIES  # noqa: F401
