"""A group of named queries with their SQL twins."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries, self.oracle = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def register(function):
            self.queries[name] = function
            if sql:
                self.oracle[name] = sql
            return function

        return register
