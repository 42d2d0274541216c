"""Named plans and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, tuple[Plan, str | None]] = {}


#: Plans over given literal rows: cases for the tests, not queries.
CASES: dict[str, tuple[Plan, str | None]] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under `name`; without `sql` it has tests of its own."""
    return _into(PLANS, name, sql)


def case(name: str, sql: str) -> Callable[[Plan], Plan]:
    return _into(CASES, name, sql)


def _into(where: dict, name: str, sql: str | None) -> Callable[[Plan], Plan]:
    def register(f: Plan) -> Plan:
        if name in PLANS or name in CASES:
            raise ValueError(f"{name} is registered twice")
        where[name] = (f, sql)
        return f

    return register
