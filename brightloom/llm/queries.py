"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from brightloom.llm import alignment, exact_dedup, lexical_search, media, mixing, packing, pii, quality, secrets, sharding, simhash, suffix_dedup, token_store

MODULES = (exact_dedup, media, secrets, mixing, packing, suffix_dedup, pii, simhash, token_store, quality, alignment, lexical_search, sharding)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
