"""Queries over the driver tables, by operator, with the SQL that each is checked against.

Every query runs over whole tables. A limit stands only where the operator is a top-k report.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from coderill.adapters import PART_VIEWS, Logical, Parts, with_views

_QUERIES: dict[str, Callable[[Logical], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Views that several queries of one module share.
SHARED: dict[str, str] = {}
#: Queries that are also run with parts as modules, under their name and ``_parts``.
OVER_PARTS = (
    "gr_edges", "gr_scc", "gr_cycle_table", "resolve_first", "resolve_tiered", "jn_import_module_or", "set_imports_sym", "mx_structural", "agg_afferent", "agg_efferent", "agg_instability", "agg_instability_stats", "agg_import_counts", "agg_group_concat",
)


def query(sql: str | None = None) -> Callable:
    """Register a function of the logical tables under its own name."""

    def register(f: Callable[[Logical], DataFrame]) -> Callable[[Logical], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def registered(name: str) -> tuple[Callable[[Logical], DataFrame], str]:
    """A query that is there already, and its SQL."""
    return _QUERIES[name], _SQL[name]


@cache
def _load() -> None:
    from coderill.plans import coupling, crosscut, history, structure, text  # noqa: F401, I001
    from coderill.plans import own  # noqa: F401  (after those that it takes up)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    found = {name: (lambda spark, sf_dir, f=f: f(Logical(spark, sf_dir))) for name, f in _QUERIES.items()}
    return found | {f"{name}_parts": (lambda spark, sf_dir, f=_QUERIES[name]: f(Parts(spark, sf_dir))) for name in OVER_PARTS}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql, SHARED) for name, sql in _SQL.items()} | {f"{name}_parts": with_views(_SQL[name], SHARED | PART_VIEWS) for name in OVER_PARTS}
