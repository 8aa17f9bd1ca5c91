"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """O1/O2: union by column name; with ``allow_missing`` absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def difference(a: DataFrame, b: DataFrame, keys=None) -> DataFrame:
    """O3: rows (or keys) of ``a`` not in ``b``: ``EXCEPT DISTINCT`` or left-anti join."""
    if keys is None:
        return a.subtract(b)
    return a.join(b.select(*keys), list(keys), "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys=None) -> DataFrame:
    """Rows of ``a`` also in ``b`` (semi join on keys, or ``INTERSECT``)."""
    if keys is None:
        return a.intersect(b)
    return a.join(b.select(*keys), list(keys), "left_semi")


def column_difference(df: DataFrame, remove) -> list[str]:
    """Columns of ``df`` minus ``remove`` (schema-only, order kept)."""
    drop = set(remove)
    return [c for c in df.columns if c not in drop]
