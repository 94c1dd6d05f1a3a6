"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from fusionframe.fixtures import with_views

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = with_views(sql)
