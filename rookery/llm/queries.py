"""All queries of the subpackage, with their SQL."""

from __future__ import annotations

from rookery.llm import abuse, bitmaps, encoding, handwritten, leakage, quantiles

MODULES = (quantiles, bitmaps, handwritten, encoding, leakage, abuse)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
