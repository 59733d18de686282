"""Named queries over the test tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
