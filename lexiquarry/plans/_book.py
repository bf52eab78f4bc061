"""A book of queries: ``@book("name", sql)`` registers a function of (spark, sf_dir)."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add
