"""Registration of a query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(run: Callable) -> Callable:
            self.QUERIES[run.__name__] = run
            if sql:
                self.SQL[run.__name__] = sql
            return run

        return add
