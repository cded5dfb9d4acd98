"""Helpers that write the DuckDB oracle SQL texts used by the registry."""

from __future__ import annotations


def tall_sql(table: str, cols: list[str], name: str = "variable", value: str = "value") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {table}" for c in cols)


def tall_str_sql(table: str, cols: list[str], name: str = "column_name",
                 value: str = "category") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS {name}, CAST({c} AS VARCHAR) AS {value} FROM {table}" for c in cols)


def r4(expr: str, digits: int = 4) -> str:
    return f"(ROUND(({expr}), {digits}) + 0.0)"
