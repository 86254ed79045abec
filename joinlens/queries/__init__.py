"""Named queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with dicts QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("corpus", "dialect", "labels", "plans", "results", "estimates", "learned", "steps")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        found = import_module(f"joinlens.queries.{m}").QUERIES
        if twice := out.keys() & found.keys():
            raise ValueError(f"query names used twice: {sorted(twice)}")
        out |= found
    return out


def all_oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"joinlens.queries.{m}").ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["subplan_actual_total_g3"](spark, sf_dir)
