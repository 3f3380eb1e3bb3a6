"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` as a query; without SQL it is checked by tests only."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_values(rows) -> str:
    """VALUES rows; numbers as they are, everything else as text."""
    def one(v):
        return str(v) if isinstance(v, (int, float)) else quoted(v)
    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
