"""All queries of the core, by name."""

from __future__ import annotations

from . import access_queries, delta_queries, exchange_queries, found, merge_queries, ops_queries, scan_queries, state_queries

_REGISTRIES = [merge_queries.query, scan_queries.query, delta_queries.query, access_queries.query, ops_queries.query, exchange_queries.query, state_queries.query]

QUERIES = {**found.QUERIES}
ORACLES = {**found.ORACLES}
for _registry in _REGISTRIES:
    QUERIES |= _registry.queries
    ORACLES |= _registry.oracles
