"""Queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from quern.session import table


class Registry:
    """Operators over named tables, each with the DuckDB SQL for the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, operator: Callable[..., DataFrame], sql: str | None, *tables: str) -> None:
        self.queries[name] = lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))
        if sql is not None:
            self.sql[name] = sql


def values_sql(rows: Iterable[tuple], *names: str) -> str:
    """A literal table for FROM."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({', '.join(names)})"


def literal(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)


def rules_sql(rules, expr: str, otherwise: str) -> str:
    """An ordered CASE of substring rules."""
    tests = (f"WHEN {' OR '.join(f'contains({expr}, {literal(p)})' for p in parts)} THEN {literal(name)}" for name, parts in rules)
    return f"CASE {' '.join(tests)} ELSE {literal(otherwise)} END"


def lookup_sql(expr: str, values: dict, otherwise) -> str:
    """A CASE over a small literal table."""
    return f"CASE {expr} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in values.items()) + f" ELSE {literal(otherwise)} END"
