"""Running stored queries again and again, to measure them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from joinlens.operators.cards import OK, within

#: Fixed value: seconds added to a timeout in the runtime of a query that met it.
PAST = 9


def replay(spark: SparkSession, queries: DataFrame, known: DataFrame, repetitions: int = 1, timeout_ms: int = 900_000, clear: bool = True) -> DataFrame:
    """(sql_key, repetition, runtime, status, n_rows) of the queries (sql_key, sql) whose key known lacks.

    Queries run one after another, as their runtimes are what is wanted; clear empties Spark's cache before each. A query that
    exceeds the timeout is recorded with timeout / 1000 + PAST seconds and not repeated; one that fails has status exception.
    """
    rows = []
    todo = queries.select("sql_key", "sql").dropDuplicates(["sql_key"]).join(known.select("sql_key").distinct(), "sql_key", "left_anti")
    for r in todo.orderBy("sql_key").toLocalIterator():
        for repetition in range(repetitions):
            if clear:
                spark.catalog.clearCache()
            began = time.perf_counter()
            try:
                status, found = within(spark, lambda sql=r["sql"]: spark.sql(sql).collect(), timeout_ms / 1000, r["sql_key"])
            except Exception:  # noqa: BLE001 - whatever stops one query is recorded, the others go on
                rows.append((r["sql_key"], repetition, None, "exception", None))
                break
            took = time.perf_counter() - began if status == OK else timeout_ms / 1000 + PAST
            rows.append((r["sql_key"], repetition, took, status, len(found) if status == OK else None))
            if status != OK:
                break
    return spark.createDataFrame(rows, "sql_key string, repetition int, runtime double, status string, n_rows long")
