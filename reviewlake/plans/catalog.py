"""All queries of the core, with the SQL they are compared with."""

from __future__ import annotations

FLAGSHIP = "context_pack"


def _load():
    from . import evaluation, files, graph, resolution, review, snapshots, streams, texts  # noqa: F401 - they register their queries
    from .registry import QUERIES, SQL

    return QUERIES, SQL


def queries() -> dict:
    return dict(_load()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_load()[1])
