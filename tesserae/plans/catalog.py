"""All registered queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from tesserae.plans import depth_queries, detail_queries, graph_queries, model_queries, relational_queries, selection_queries, source_queries, version_queries

MODULES = [graph_queries, model_queries, relational_queries, version_queries, selection_queries, detail_queries, depth_queries, source_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
