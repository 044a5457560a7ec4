"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations


def _modules():
    from lodestack.plans import answering, catalogue, dialogue, etl, retrieval

    return [retrieval, catalogue, dialogue, etl, answering]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
