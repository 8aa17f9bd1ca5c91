"""Queries of the operators of this subpackage and, where SQL can express
them, their DuckDB SQL."""

from __future__ import annotations

from curatio.llm.common import prepare

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
