"""Registration helper: one dict of query callables and one of oracle SQL per module."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, key: str, sql: str | None = None):
        def keep(fn):
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn

        return keep
