"""Access to the driver's tables and registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joinlens.session import load


class Tables:
    """Tables of a data directory as attributes: t.orders, or t("orders", "o") with an alias."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)

    def __call__(self, name: str, alias: str | None = None) -> DataFrame:
        table = load(self.spark, self.sf_dir, name)
        return table.alias(alias) if alias else table

    def views(self, *names: str) -> SparkSession:
        """The session, with the tables as temporary views."""
        for name in names:
            load(self.spark, self.sf_dir, name).createOrReplaceTempView(name)
        return self.spark


class Registry:
    """Collects queries: @registry.add("SELECT ...") over a function of Tables."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def take(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            key = name or function.__name__
            self.queries[key] = lambda spark, d: function(Tables(spark, d))
            if sql:
                self.oracles[key] = sql
            return function

        return take
