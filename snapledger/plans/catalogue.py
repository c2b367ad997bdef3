"""All registered queries over the driver tables, and their DuckDB counterparts."""

from __future__ import annotations

from snapledger.plans import commit_queries, discovery_queries, feed_queries, lifecycle_queries, resolution_queries, source_queries, state_queries, text_queries

MODULES = (feed_queries, state_queries, text_queries, discovery_queries, lifecycle_queries, resolution_queries, source_queries, commit_queries)
FLAGSHIP = "feed_recent"
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
