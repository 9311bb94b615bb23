"""Operators for training-data pipelines.  Nothing else in the library imports this."""

from __future__ import annotations

from importlib import import_module

#: Modules in the order of their operators' numbers.
MODULES = ("suffix_dedup", "languages", "pii", "decontaminate", "chat", "mixing", "lm_score", "secrets", "simhash", "topk", "fingerprints", "divergence", "resampling")


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__name__}.{m}").ORACLE.items()}
