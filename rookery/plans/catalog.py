"""All queries of the core, with their SQL."""

from __future__ import annotations

from rookery.operators import context, diff, evaluate, graph, identity, outline, packets, projections, quality, retrieval, snapshots, structure, trailing, usage
from rookery.sources import scan, sink

FLAGSHIP = "p2_rolling"
MODULES = (trailing, snapshots, usage, identity, diff, graph, retrieval, context, quality, evaluate, structure, scan, projections, sink, packets, outline)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
