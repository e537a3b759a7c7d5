"""Importing this package registers all queries."""

import importlib

from freightloom.plans.registry import ORACLE, QUERIES  # noqa: F401

for _name in ("analytics", "quality", "features", "scalars", "graph_build", "graph_walk", "patterns", "evaluate", "joins", "reports", "text", "models", "store", "streaming"):
    importlib.import_module(f"freightloom.plans.{_name}")
