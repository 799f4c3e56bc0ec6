"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class _Catalog:
    run: dict[str, Query]
    sql: dict[str, str]


_ALL = _Catalog({}, {})


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with equivalent SQL where there is one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _ALL.run:
            raise ValueError(f"two queries named {key}")
        _ALL.run[key] = f
        if sql:
            _ALL.sql[key] = sql
        return f

    return add


def _load() -> _Catalog:
    from . import documents, library, pages, pdf, rules, state  # noqa: F401  they register their queries

    return _ALL


def queries() -> dict[str, Query]:
    return dict(_load().run)


def oracle_sql() -> dict[str, str]:
    return dict(_load().sql)
