"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("operators.text_queries", "operators.scoring", "operators.relational", "operators.signal_queries", "operators.pipeline_queries", "plans.model_queries", "streaming.ingest")


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"earshot.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"earshot.{m}").ORACLE.items()}
