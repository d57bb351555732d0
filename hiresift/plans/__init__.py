"""Registered queries and the tables that they run on."""

from __future__ import annotations

from importlib import import_module

MODULES = ("analytics", "texts", "learning", "domains", "nlp", "whole_score", "judged", "streams")


def all_queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"{__name__}.{m}").registry.queries.items()}


def all_oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").registry.oracle.items()}
