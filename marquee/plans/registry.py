"""All queries of the core with their SQL oracles, by name."""

from __future__ import annotations

from marquee.plans import core_problems, feed_queries, page_queries, read_queries

QUERIES = {**core_problems.QUERIES, **read_queries.QUERIES, **feed_queries.QUERIES, **page_queries.QUERIES}
ORACLES: dict[str, str] = {**core_problems.ORACLES, **read_queries.ORACLES, **feed_queries.ORACLES, **page_queries.ORACLES}
