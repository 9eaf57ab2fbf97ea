"""Jobs: each module registers its queries."""

from __future__ import annotations

from latticework.jobs import files, geometry, graph, lists, matrix, mesh, spatial  # noqa: F401
from latticework.jobs.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
