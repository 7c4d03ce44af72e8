"""Registered queries: name -> function of (session, folder) and, where SQL can express it, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, adapters: bool = True) -> Callable[[Query], Query]:
    """Registers a function under its name; sql follows the adapters' common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (tables.SQL if adapters else "") + sql
        return f

    return register


def cents(x: str) -> str:
    return f"cast(({x}) * 100 as bigint)"


def half_up(num: str, den: str) -> str:
    """num / den rounded half away from zero, in integers; null where den is 0."""
    return f"(case when ({den}) = 0 then null else cast(sign({num}) * ((2 * abs({num}) + abs({den})) // (2 * abs({den}))) * sign({den}) as bigint) end)"


def half_even(num: str, den: str) -> str:
    """For non-negative integers."""
    n, d = f"cast({num} as bigint)", f"cast({den} as bigint)"
    return f"(case when ({den}) = 0 then null else {n} // {d} + case when 2 * ({n} % {d}) > {d} or (2 * ({n} % {d}) = {d} and ({n} // {d}) % 2 = 1) then 1 else 0 end end)"


def dec(x: str) -> str:
    """Integer cents as decimal(18,2)."""
    return f"cast(cast({x} as bigint) * 0.01 as decimal(18,2))"


def pct(part: str, whole: str) -> str:
    return dec(half_up(f"{cents(part)} * 10000", cents(whole)))


def d2(x: str) -> str:
    return f"cast({x} as decimal(18,2))"
