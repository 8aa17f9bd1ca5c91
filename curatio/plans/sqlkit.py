"""DuckDB SQL fragments mirroring the Spark column functions (oracle side)."""

from __future__ import annotations

from curatio.functions.hashing import sql_hkey

# Python str.strip() whitespace (Java (?U)\s plus \x1c-\x1f), as an RE2 class.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def lit(s: str) -> str:
    """SQL string literal; newlines and quotes spelled out."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def split(x: str, sep: str) -> str:
    return f"string_split({x}, {lit(sep)})"


def part(x: str, sep: str, i: int) -> str:
    """0-based part of a literal split (null when out of range)."""
    return f"{split(x, sep)}[{i + 1}]"


def hash_rank(partition: list[str], seed, keys: list[str]) -> str:
    pb = ("PARTITION BY " + ", ".join(partition)) if partition else ""
    return f"row_number() OVER ({pb} ORDER BY {sql_hkey(seed, *keys)}, {', '.join(keys)})"


def word_count(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE CAST(len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')) AS BIGINT) END"


def r6(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"
