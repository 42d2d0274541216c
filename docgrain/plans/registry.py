"""All plans of the engine."""

from . import access, aggregates, conversations, evaluation, graphs, ingest, joins, parsing, retrieval, streams, texts, wholes, windows  # noqa: F401
from ._registry import PLANS


def queries() -> dict:
    return {name: f for name, (f, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
