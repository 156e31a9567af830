"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_simhash", "queries_files", "queries_pieces", "queries_html", "queries_quality", "queries_pii", "queries_decontaminate", "queries_chat", "queries_chains", "queries_urls", "queries_merkle", "queries_divergence")


def _gather(attribute: str) -> dict:
    return {name: value for module in MODULES for name, value in getattr(import_module(f"quern.llm.{module}"), attribute).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict[str, str]:
    return _gather("ORACLES")
