"""Every registered query with its DuckDB oracle; modules add themselves in MODULES."""

from __future__ import annotations

from importlib import import_module

#: Each module has QUERIES {name: callable(spark, sf_dir)} and ORACLES {name: sql}.
MODULES = [
    "tidewright.operators.kv",
    "tidewright.operators.queue",
    "tidewright.operators.metrics",
    "tidewright.operators.state",
    "tidewright.operators.history",
    "tidewright.operators.chains",
    "tidewright.operators.deadlines",
    "tidewright.operators.subscriptions",
    "tidewright.functions.scalars",
    "tidewright.plans.dag",
    "tidewright.plans.documents",
    "tidewright.plans.merge",
    "tidewright.plans.workflows",
]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLES.items()}
