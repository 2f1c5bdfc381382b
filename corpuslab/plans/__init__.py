"""All registered queries of the library, by name."""

from __future__ import annotations

from corpuslab.plans import corpus, curation, files, operations, retrieval, streams
from corpuslab.plans.registry import Query

AREAS = (retrieval, corpus, curation, operations, streams, files)


def queries() -> dict[str, Query]:
    return {name: query for area in AREAS for name, query in area.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.R.sql.items()}
