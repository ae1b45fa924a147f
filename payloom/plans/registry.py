"""All registered queries of the library and their SQL."""

from __future__ import annotations

from payloom.plans import catalogue


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict:
    return dict(catalogue.ORACLES)
