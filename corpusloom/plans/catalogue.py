"""All queries of the engine by name, and their SQL for DuckDB."""

from __future__ import annotations

from . import harness, operators, records
from .dialect import Sql
from .facts import FACTS, JOURNAL, QUALITY
from .texts import NUMBERS, TEXTS


def _texts() -> dict[str, Sql]:
    return FACTS | QUALITY | JOURNAL | TEXTS | NUMBERS


def _runs() -> dict:
    return operators.QUERIES | harness.QUERIES | records.QUERIES


def queries() -> dict:
    return _texts() | {name: run for name, (run, _) in _runs().items()}


def oracle_sql() -> dict:
    return {name: q.duck() for name, q in _texts().items()} | {name: sql for name, (_, sql) in _runs().items() if sql}
