"""The registry of queries and of their SQL counterparts."""

from __future__ import annotations

from quarry.queries import acts, catalog, marks, records, retrieval, search, sequence, stores, text, workflow

MODULES = (retrieval, catalog, sequence, text, marks, workflow, search, acts, records, stores)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
