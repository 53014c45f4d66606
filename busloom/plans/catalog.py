"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from busloom.plans.registry import Query

MODULES = (
    "trip_queries", "gps_queries", "series_queries", "service_queries", "eda_queries", "model_queries", "tree_queries",
    "evaluation_queries", "source_queries", "pipeline_queries", "published_queries",
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for q in import_module(f"busloom.plans.{module}").QUERIES:
            if q.name in found:
                raise ValueError(f"query registered twice: {q.name}")
            found[q.name] = q
    return found
