"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from textloom.llm import catalog_audit, catalog_groups, catalog_native, catalog_tokens

QUERIES = {**catalog_native.QUERIES, **catalog_tokens.QUERIES, **catalog_groups.QUERIES, **catalog_audit.QUERIES}
ORACLES = {**catalog_native.ORACLES, **catalog_groups.ORACLES, **catalog_audit.ORACLES}
