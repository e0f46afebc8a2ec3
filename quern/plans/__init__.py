"""Queries over the driver tables, and the SQL that states the same result."""

from __future__ import annotations


def _modules() -> list:
    from quern.plans import assessment, checks, graph, judgement, logs, memory, rules, sinks, storage, streams, text

    return [text, rules, judgement, assessment, checks, memory, logs, graph, storage, sinks, streams]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.SQL
    return out
