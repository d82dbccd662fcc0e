"""Query plans over the given tables."""

from __future__ import annotations

import importlib

PARTS = ["q_text", "q_dates", "q_classify", "q_signals", "q_scoring", "q_evaluate", "q_feed",
         "q_monitor"]


def all_queries():
    """The registry with every part loaded."""
    from matchloom.plans import registry
    for part in PARTS:
        importlib.import_module(f"matchloom.plans.{part}")
    return registry
