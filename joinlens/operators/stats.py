"""Column statistics, frequency tables and textbook size estimates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators.cards import Loader
from joinlens.workload.spec import JoinQuery, Predicate, key


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_name, num, low, high): distinct values and the range as numbers, from one aggregate over stacked columns.

    Every value travels once as (column, text) after map-side combining, however many columns there are.
    """
    kinds = dict(df.dtypes)
    cells = [
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value"), (F.lit(None) if kinds[c].startswith("string") else F.col(c)).cast("double").alias("x"))
        for c in columns
    ]
    stacked = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("value IS NOT NULL")
    each = stacked.groupBy("col_name", "value").agg(F.first("x").alias("x"))
    return each.groupBy("col_name").agg(F.count(F.lit(1)).alias("num"), F.min("x").alias("low"), F.max("x").alias("high"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_name, min_value, max_value, num_values, total_values, null_values) as text and counts.

    num_values counts null as one value.
    """
    aggs = []
    for c in columns:
        aggs += [F.min(c).cast("string").alias(f"{c}__lo"), F.max(c).cast("string").alias(f"{c}__hi"), F.count(c).alias(f"{c}__n")]
    one = df.agg(F.count(F.lit(1)).alias("__all"), *aggs)
    rows = F.array(*(
        F.struct(F.lit(c).alias("col_name"), F.col(f"{c}__lo").alias("min_value"), F.col(f"{c}__hi").alias("max_value"), F.col(f"{c}__n").alias("n"), F.col("__all").alias("total_values"))
        for c in columns
    ))
    made = one.select(F.explode(rows).alias("x")).select("x.*").join(F.broadcast(distinct_counts(df, columns)), "col_name", "left")  # a row a column
    nulls = F.col("total_values") - F.col("n")
    num = F.coalesce("num", F.lit(0)) + F.when(nulls > 0, 1).otherwise(0)
    return made.select("col_name", "min_value", "max_value", num.alias("num_values"), "total_values", nulls.alias("null_values"))


def value_lists(df: DataFrame, column: str, most: int = 5000) -> DataFrame:
    """One row with the sorted distinct values of a column that has at most `most`, else none."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1)
    return values.agg(F.array_sort(F.collect_list(column)).alias("vals")).where(F.size("vals") <= most)


def selectivity(p: Predicate, ndv: int, low: float | None, high: float | None, nulls: int, total: int) -> float:
    """Share of rows that a predicate keeps, by the textbook rules."""
    if p.op == "eq":
        return 1 / max(ndv, 1)
    if p.op == "ne":
        return 1 - 1 / max(ndv, 1)
    if p.op == "in":
        return min(1.0, len(p.values) / max(ndv, 1))
    if p.op == "range":
        if low is None or high is None or high <= low:
            return 1.0
        lo, hi = p.values
        lo, hi = low if lo is None else lo, high if hi is None else hi
        return min(1.0, max(0.0, (hi - lo) / (high - low)))
    if p.op in ("like", "not_like"):
        share = 0.05 if not p.values[0].startswith("%") else 0.1
        return share if p.op == "like" else 1 - share
    share = nulls / max(total, 1)
    return share if p.op == "null" else 1 - share


def estimate_inputs(load: Loader, query: JoinQuery) -> dict[str, dict[str, tuple]]:
    """alias -> column -> (ndv, low, high, nulls, total) for the join and filter columns, in one job; a row a column is collected."""
    parts, wanted = [], {}
    for alias, table in query.tables.items():
        joins = {c for e in query.edges for a, c in ((e.a, e.ca), (e.b, e.cb)) if a == alias}
        wanted[alias] = sorted(joins | {p.column for p in query.preds.get(alias, ())})
        df, columns = load(table), wanted[alias]
        counts = df.agg(F.count(F.lit(1)).alias("all"), *(F.count(c).alias(f"n_{c}") for c in columns))
        cells = [F.struct(F.lit(c).alias("col_name"), F.col(f"n_{c}").alias("n")) for c in columns] + [F.struct(F.lit("").alias("col_name"), F.col("all").alias("n"))]
        kinds = F.lit(None).cast("double")
        parts.append(counts.select(F.explode(F.array(*cells)).alias("s")).select(F.lit(alias).alias("alias"), "s.*", kinds.alias("low"), kinds.alias("high"), F.lit(True).alias("whole")))
        if columns:
            distinct = distinct_counts(df, columns)
            parts.append(distinct.select(F.lit(alias).alias("alias"), "col_name", F.col("num").alias("n"), "low", "high", F.lit(False).alias("whole")))
    rows = reduce(DataFrame.unionByName, parts).collect()
    filled = {(r["alias"], r["col_name"]): r["n"] for r in rows if r["whole"]}
    values = {(r["alias"], r["col_name"]): (r["n"], r["low"], r["high"]) for r in rows if not r["whole"]}
    out: dict[str, dict[str, tuple]] = {}
    for alias, columns in wanted.items():
        total = filled[alias, ""]
        out[alias] = {c: (*values.get((alias, c), (0, None, None)), total - filled[alias, c], total) for c in columns}
        out[alias][""] = (total,) * 5
    return out


def expected_counts(spark: SparkSession, load: Loader, query: JoinQuery) -> DataFrame:
    """(qid, subset, n_tables, value): filtered sizes times 1 / max(distinct, distinct) over a spanning set of edges; 1 at least."""
    facts = estimate_inputs(load, query)
    rows = []
    for s in query.subsets():
        value = 1.0
        for a in s:
            value *= facts[a][""][0] * reduce(lambda x, p: x * selectivity(p, *facts[a][p.column]), query.preds.get(a, ()), 1.0)
        parent = {a: a for a in s}

        def find(a: str) -> str:
            while parent[a] != a:
                a = parent[a]
            return a

        for e in query.edges:
            if e.op == "=" and e.a in parent and e.b in parent and find(e.a) != find(e.b):
                parent[find(e.a)] = find(e.b)
                value /= max(facts[e.a][e.ca][0], facts[e.b][e.cb][0], 1)
        rows.append((query.qid, key(s), len(s), max(value, 1.0)))
    return spark.createDataFrame(rows, "qid string, subset string, n_tables int, value double")


def planner_rows(spark: SparkSession, sql: str) -> int | None:
    """Catalyst's own row estimate of a query (set spark.sql.cbo.enabled over analyzed tables); None without statistics."""
    stats = spark.sql(sql)._jdf.queryExecution().optimizedPlan().stats()
    count = stats.rowCount()
    return int(str(count.get())) if count.isDefined() else None


def plan_nodes(spark: SparkSession, sql: str) -> DataFrame:
    """(node, parent, depth, operator, detail) of the optimized plan of a query."""
    text = spark.sql(sql)._jdf.queryExecution().optimizedPlan().treeString()
    rows, stack = [], []
    for at, line in enumerate(x for x in text.splitlines() if x.strip()):
        body = re.sub(r"^[\s:|+\-]*", "", line)
        depth = (len(line) - len(body)) // 3
        stack = stack[:depth]
        rows.append((at, stack[-1] if stack else None, depth, body.split(" ")[0].split("(")[0], body))
        stack.append(at)
    return spark.createDataFrame(rows, "node int, parent int, depth int, operator string, detail string")


_METHODS = {"BroadcastNestedLoopJoin": "nested", "CartesianProduct": "nested", "SortMergeJoin": "merge", "BroadcastHashJoin": "hash", "ShuffledHashJoin": "hash"}


def physical_joins(spark: SparkSession, sql: str) -> DataFrame:
    """(operator, method) of every join of the physical plan that a query starts with."""
    text = spark.sql(sql)._jdf.queryExecution().sparkPlan().treeString()
    names = (re.sub(r"^[\s:|+\-*()\d]*", "", line).split(" ")[0].split("(")[0] for line in text.splitlines())
    return spark.createDataFrame([(n, _METHODS[n]) for n in names if n in _METHODS], "operator string, method string")
