"""Query plans over the driver tables, registered by name."""

from __future__ import annotations

import importlib

MODULES = ["q_windows", "q_intervals", "q_aggregates", "q_relational", "q_functions", "q_stats", "q_models", "q_scoring", "q_sources", "q_streaming"]


def load_all():
    from ratecast.plans.registry import REGISTRY
    for m in MODULES:
        importlib.import_module(f"ratecast.plans.{m}")
    return REGISTRY
