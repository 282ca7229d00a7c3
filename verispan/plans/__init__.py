"""Named queries over the driver's tables."""

from __future__ import annotations

import importlib

_MODULES = ("reference_queries", "claim_queries", "audit_queries", "text_queries", "dataset_queries", "study_queries", "source_queries")


def core_registry():
    """The registry, with every query module of the core loaded."""
    from verispan.plans.registry import CORE

    for m in _MODULES:
        importlib.import_module(f"verispan.plans.{m}")
    return CORE
