"""All queries over the panel, and their oracles."""

from __future__ import annotations

from pitgrid.plans import audit_queries, decision_queries, evidence_queries, gate_queries, ledger_queries, panel_queries, payload_queries, record_queries, rule_queries, source_queries, stream_queries, validator_queries  # noqa: F401
from pitgrid.plans.registry import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {k: e.run for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in REGISTRY.items() if e.sql}
