"""All registered queries of the core library and their SQL twins."""

from __future__ import annotations

from concordat.plans import annotations, checks, knowledge, live, records, search, statistics, storage, structures, voting

FLAGSHIP = "srt_04_knn"
_MODULES = [annotations, checks, storage, search, knowledge, voting, statistics, structures, live, records]


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
