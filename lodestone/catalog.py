"""Queries of the engine by name, their DuckDB statements, and the flagship."""

from __future__ import annotations

from .plans import answer, histories, learned, records, relational, retrieval, roundtrips, service, stored, streams, textual, vectors

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (retrieval, textual, histories, relational, streams, records, service, roundtrips, answer, vectors, stored, learned):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
FLAGSHIP = "funnel"
