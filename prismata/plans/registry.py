"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


from . import labels, more, reports, sampling, scoring, sequences, similar  # noqa: E402, F401
