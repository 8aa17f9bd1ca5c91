"""Deterministic, partition-independent randomness.

Every random step in the library is a pure function of ``(seed, key)``:
``h = md5(seed || '|' || key...)``.  The same hex string comes out of Spark
and DuckDB, so every sampling operator has an exact SQL oracle and gives the
same rows whatever the partitioning, the executor count or a retried task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hkey(seed, *cols) -> Column:
    """md5 hex of ``seed|k1|k2...`` (nulls skipped, as in ``concat_ws``)."""
    parts = [F.lit(str(seed))] + [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def draw(seed, *cols) -> Column:
    """Non-negative 60-bit integer from the first 15 hex digits of :func:`hkey`."""
    return F.conv(F.substring(hkey(seed, *cols), 1, 15), 16, 10).cast("long")


def sql_hkey(seed, *exprs: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"md5(concat_ws('|', {inner}))"


def sql_draw(seed, *exprs: str) -> str:
    return f"CAST(('0x' || substr({sql_hkey(seed, *exprs)}, 1, 15)) AS BIGINT)"
