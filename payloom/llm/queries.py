"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "warc", "simhash", "pieces", "secrets", "quality", "matroska", "suffix_tree", "toxicity", "token_store")


def _collect(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"payloom.llm.{name}"), kind)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
