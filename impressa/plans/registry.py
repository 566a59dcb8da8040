"""Registered queries: one Spark plan per inventory item, each with its DuckDB oracle where SQL
can say it.  Every plan reads the driver's tables through the fixture views, so its work grows
with them.  ``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        from impressa.plans.output import bias_sql
        QUERIES[name] = (fn, bias_sql(sql) if sql else None)
        return fn
    return deco


def load_all():
    # importing the modules registers their queries
    from impressa.plans import q_metrics, q_prepare, q_analytics, q_cooccur, q_scoring, q_misc, q_io, q_training  # noqa: F401
    return QUERIES
