"""All queries of the library with their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> function of session and table folder) and SQL (name -> text).
MODULES = ("itemforge.plans.mining_queries", "itemforge.plans.scoring_queries", "itemforge.plans.record_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).SQL
    return out
