"""All registered queries of the reference's operators, collected from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search", "scalar", "terms", "retrieval", "graph", "pipeline_stages", "quality", "streams", "relational", "layout", "resolve", "ranking", "code", "catalogue", "extension", "writing")


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"evidex.plans.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")


def coverage() -> dict[str, tuple[str, ...]]:
    """Query name -> operator IDs of the inventory that it exercises."""
    return _collect("COVERAGE")
