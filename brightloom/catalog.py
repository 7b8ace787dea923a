"""All registered queries of the library outside the optional subpackage."""

from __future__ import annotations

from brightloom.queries import corpus, crawl, decisions, engine, evidence, graph, payloads, review, rollups, search, stats, surface, tables

MODULES = (search, engine, decisions, stats, rollups, corpus, graph, crawl, evidence, review, payloads, surface, tables)

QUERIES = {name: f for m in MODULES for name, f in m.registry.queries.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.registry.sql.items()}
