"""All registered queries and their SQL."""

from __future__ import annotations

from placeframe.plans import composite, contracts, jobs, land, more, news, places, roads, scores, streams, streets, tables

QUERIES, SQL = {}, {}
for part in (scores, places, tables, more, composite, roads, jobs, streams, land, contracts, streets, news):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
