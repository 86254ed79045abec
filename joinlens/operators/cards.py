"""Row counts of every connected sub-join of a query."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.session import path_exists
from joinlens.workload.spec import Edge, JoinQuery, key

Loader = Callable[[str], DataFrame]
#: Status values; a sentinel number is never stored as a count.
OK, CROSS_JOIN, TIMEOUT, EXCEPTION = "ok", "cross_join", "timeout", "exception"
#: The numbers that stand for a status in the compatible view.
SENTINELS = {CROSS_JOIN: 150001000000, TIMEOUT: 150001000001, EXCEPTION: 150001000002}


def _member_rows(load: Loader, query: JoinQuery, alias: str, members: list[JoinQuery]) -> DataFrame:
    """Rows of an alias, once for each member whose filters they meet (__q), with its join columns. The table is read once."""
    df = load(query.tables[alias])
    met = []
    for at, member in enumerate(members):
        tests = [p.condition(df) for p in member.preds.get(alias, ())]
        met.append(F.when(reduce(lambda x, y: x & y, tests), at) if tests else F.lit(at))
    columns = sorted({c for e in query.edges for a, c in ((e.a, e.ca), (e.b, e.cb)) if a == alias})
    return df.select(*columns, F.explode(F.array_compact(F.array(*met))).alias("__q"))


def _tree_counts(
    load: Loader, query: JoinQuery, wanted: list[tuple[str, ...]], filters: bool, members: list[JoinQuery] | None = None,
    closing: Edge | None = None,
) -> list[DataFrame]:
    """Counts of all wanted subsets that are trees, without any join result.

    closing: an equality beside the tree, which all wanted subsets hold (a cycle, as redundant conditions make it). The values
    of its two columns travel up with the messages, as further group keys, until they meet at the first alias above both.

    members: queries with the tables and edges of query and filters of their own, counted together; __q then tells the
    member by its number, and members without rows are absent.

    The tree is rooted; a subset is counted at its alias nearest the root. Every alias is read once: its rows meet the
    messages of its children (one row a join key, one column for each subset that ends at the child), and each subset that
    ends at the alias is a product of message columns. Grouped by the key to the parent, these are the alias's own messages.
    Counts of n subsets so cost one aggregate and one join an alias, all on foreign keys.
    """
    todo, rooted, out = set(query.tables), {}, []
    by = ["__q"] if members else []
    while todo:
        root = sorted(todo, key=lambda a: (-len(query.neighbours(a)), a))[0]
        order, parent = [root], {root: None}
        for a in order:
            for b in sorted(query.neighbours(a)):
                if b not in parent:
                    parent[b] = a
                    order.append(b)
        todo -= set(order)
        edge_to = {a: next(e for e in query.edges if {e.a, e.b} == {a, parent[a]}) for a in order if parent[a]}
        ends = {closing.a: closing.ca, closing.b: closing.cb} if closing and closing.a in parent else {}
        carried: dict[str, list[str]] = {}
        below = {a: {a} for a in order}
        for a in reversed(order[1:]):
            below[parent[a]] |= below[a]
        for alias in reversed(order):
            # what wanted subsets hold of the alias and all below it; nothing else is summed
            tops = sorted({tuple(sorted(below[alias] & set(s))) for s in wanted if alias in s}, key=lambda s: (len(s), s))
            keep = [(f"m_{alias}_{i}", s) for i, s in enumerate(tops) if s in wanted]
            rooted[alias], carried[alias] = (None, tops), []
            if not tops:
                continue
            children = [c for c in order if parent[c] == alias and any(below[c] & set(s) for s in tops)]
            kept = query if closing is None else replace(query, edges=(*query.edges, closing))  # its columns are read too
            rows = _member_rows(load, kept, alias, members) if members else kept.base(load, alias, filters)
            here = []
            if alias in ends:
                rows = rows.withColumn(f"__end_{alias}", F.col(ends[alias]))
                here.append(f"__end_{alias}")
            for c in children:
                e = edge_to[c]
                own, theirs = (e.ca, e.cb) if e.a == alias else (e.cb, e.ca)
                messages = rooted[c][0].withColumnsRenamed({theirs: f"__key_{c}", "__q": f"__q_{c}"})
                on = [F.col(own) == F.col(f"__key_{c}"), *(F.col(q) == F.col(f"{q}_{c}") for q in by)]
                if carried[c] and here:
                    on.append(F.col(here[0]) == F.col(carried[c][0]))
                rows = rows.join(messages, on, "inner" if carried[c] else "left").drop(f"__key_{c}", f"__q_{c}")
                here += carried[c]
            carried[alias] = here if len(here) == 1 else []
            sums = []
            for i, s in enumerate(tops):
                parts = [(c, tuple(sorted(below[c] & set(s)))) for c in children]
                used = [f"m_{c}_{rooted[c][1].index(part)}" for c, part in parts if part]
                weight = reduce(lambda x, y: x * y, (F.coalesce(F.col(m), F.lit(0)) for m in used), F.lit(1).cast("long"))
                sums.append(F.coalesce(F.sum(weight), F.lit(0).cast("long")).alias(f"m_{alias}_{i}"))
            if parent[alias]:
                e = edge_to[alias]
                up = e.ca if e.a == alias else e.cb
                rooted[alias] = (rows.where(F.col(up).isNotNull()).groupBy(up, *by, *carried[alias]).agg(*sums), tops)
            if keep:
                totals = rows.groupBy(*by).agg(*(sums[tops.index(s)] for _, s in keep))
                stack = F.explode(F.array(*(F.struct(F.lit(key(s)).alias("subset"), F.lit(len(s)).alias("n_tables"), F.col(m).alias("value")) for m, s in keep)))
                out.append(totals.select(*by, stack.alias("x")).select(*by, "x.*"))
    return out


def _forest(query: JoinQuery, first: tuple[str, ...]) -> JoinQuery:
    """The query with the equalities of one spanning forest, which holds those within the subset first."""
    parent = {a: a for a in query.tables}

    def find(a: str) -> str:
        while parent[a] != a:
            a = parent[a]
        return a

    kept = []
    for e in sorted(query.edges, key=lambda e: not (e.a in first and e.b in first)):
        if e.op == "=" and find(e.a) != find(e.b):
            parent[find(e.a)] = find(e.b)
            kept.append(e)
    return query.restricted(tuple(query.tables), tuple(kept))


def _extra_edges(query: JoinQuery, forest: JoinQuery, subset: tuple[str, ...]) -> list[Edge]:
    """Conditions within a subset that a forest of the query leaves out."""
    return [e for e in query.edges if e.a in subset and e.b in subset and e not in forest.edges]


def grouped_counts(load: Loader, query: JoinQuery, filters: bool, members: list[JoinQuery] | None = None) -> tuple[list[DataFrame], list[tuple[str, ...]]]:
    """Counts of all connected subsets that are trees, or trees and one more equality, by messages along spanning forests; and
    the subsets that remain."""
    subsets, parts = query.subsets(), []
    todo = [s for s in subsets if query.acyclic(s)]
    rest = [s for s in subsets if s not in set(todo)]
    while todo:
        forest = _forest(query, max(todo, key=len))
        here = [s for s in todo if forest.connected(set(s)) and not _extra_edges(query, forest, s)]
        parts += _tree_counts(load, forest, here, filters, members)
        todo = [s for s in todo if s not in set(here)]
    left, cyclic = [], list(rest)
    while cyclic:
        top = max(cyclic, key=len)
        forest = _forest(query, top)
        closing = _extra_edges(query, forest, top)
        if len(closing) != 1 or closing[0].op != "=" or not forest.connected(set(top)):
            left.append(top)
            cyclic.remove(top)
            continue
        here = [s for s in cyclic if forest.connected(set(s)) and _extra_edges(query, forest, s) == closing]
        parts += _tree_counts(load, forest, here, filters, members, closing[0])
        cyclic = [s for s in cyclic if s not in set(here)]
    return parts, left


def _one_count(load: Loader, query: JoinQuery, subset: tuple[str, ...], filters: bool) -> DataFrame:
    """One row (value) for a subset that is no tree.

    Where only an inequality links two parts, their pairs are never formed: the count is the product of the parts' counts
    less the count under equality.
    """
    if query.restricted(subset).acyclic(subset):
        return _tree_counts(load, query.restricted(subset), [subset], filters)[0].select("value")
    cut = query.lone_inequality(subset)
    if cut is None:
        return query.join(load, subset, filters).agg(F.count(F.lit(1)).alias("value"))
    edge, left, right = cut
    named = {edge.a: edge.ca, edge.b: edge.cb}
    sides = []
    for part in (left, right):
        alias = edge.a if edge.a in part else edge.b
        sides.append(_one_count(load, query.restricted(part, required={alias: (*query.required.get(alias, ()), named[alias])}), part, filters))
    equal = tuple(Edge(e.a, e.ca, e.b, e.cb) if e is edge else e for e in query.edges)
    same = _one_count(load, query.restricted(subset, equal), subset, filters)
    one = sides[0].withColumnRenamed("value", "x").crossJoin(sides[1].withColumnRenamed("value", "y")).crossJoin(same)  # of single rows
    return one.select((F.col("x") * F.col("y") - F.col("value")).alias("value"))


def sub_plan_counts(spark: SparkSession, load: Loader, query: JoinQuery, filters: bool = True, shared: bool = True) -> DataFrame:
    """(qid, subset, n_tables, value) of every connected subset.

    Subsets whose conditions form a tree, or a tree and one more equality, are counted by shared messages, all those within one
    spanning forest at once; as many forests are used as it takes. Subsets with further cycles are joined, inequalities that
    alone link two parts are counted by difference. shared=False joins whatever is no such inequality.
    """
    parts, rest = grouped_counts(load, query, filters) if shared else ([], query.subsets())
    for s in rest:
        plain = not shared and query.lone_inequality(s) is None
        count = query.join(load, s, filters).agg(F.count(F.lit(1)).alias("value")) if plain else _one_count(load, query, s, filters)
        parts.append(count.select(F.lit(key(s)).alias("subset"), F.lit(len(s)).alias("n_tables"), "value"))
    return reduce(DataFrame.unionByName, parts).select(F.lit(query.qid).alias("qid"), "subset", "n_tables", "value")


def actual_and_total(spark: SparkSession, load: Loader, query: JoinQuery) -> DataFrame:
    """(qid, subset, n_tables, actual, total) of every connected subset: counts with and without filters, in one pass for all
    subsets that are trees (the query and its unfiltered form are counted together)."""
    bare = replace(query, preds={})
    parts, rest = grouped_counts(load, query, True, [query, bare])
    for at, q in enumerate((query, bare)):
        for s in rest:
            parts.append(_one_count(load, q, s, True).select(F.lit(at).alias("__q"), F.lit(key(s)).alias("subset"), F.lit(len(s)).alias("n_tables"), "value"))
    found = reduce(DataFrame.unionByName, parts).groupBy("subset", "n_tables").agg(*(F.coalesce(F.max(F.when(F.col("__q") == q, F.col("value"))), F.lit(0)).alias(c) for q, c in enumerate(("actual", "total"))))
    return found.select(F.lit(query.qid).alias("qid"), "subset", "n_tables", "actual", "total")


def with_status(counts: DataFrame, query: JoinQuery) -> DataFrame:
    """Counts plus the full set where it is a cross join, which is never run."""
    full = tuple(sorted(query.tables))
    made = counts.withColumn("status", F.lit(OK))
    if query.connected(set(full)):
        return made
    spark = counts.sparkSession
    row = spark.createDataFrame([(query.qid, key(full), len(full), None, CROSS_JOIN)], "qid string, subset string, n_tables int, value long, status string")
    return made.unionByName(row)


def with_sentinels(cards: DataFrame) -> DataFrame:
    """The compatible view: sentinel numbers in the place of a status."""
    number = F.create_map(*(x for k, v in SENTINELS.items() for x in (F.lit(k), F.lit(v))))
    return cards.withColumn("value", F.coalesce("value", F.try_element_at(number, F.col("status")))).drop("status")


def clip_to_total(cards: DataFrame, actual: str = "actual", total: str = "total") -> DataFrame:
    """A count above the unfiltered one lifts the latter; selectivity is then 1."""
    lifted = F.greatest(actual, total)
    return cards.withColumn(total, lifted).withColumn("selectivity", F.when(lifted > 0, F.col(actual) / lifted))


def within(spark: SparkSession, work: Callable[[], object], timeout: float | None, label: str = "") -> tuple[str, object]:
    """(status, result) of work; after timeout seconds its jobs are cancelled."""
    group = f"joinlens-{uuid.uuid4().hex[:12]}"
    context, fired = spark.sparkContext, threading.Event()

    def stop() -> None:
        fired.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop) if timeout is not None else None
    context.setJobGroup(group, label[:100], interruptOnCancel=True)
    if timer:
        timer.start()
    try:
        return OK, work()
    except Exception:
        if fired.is_set():
            return TIMEOUT, None
        raise
    finally:
        if timer:
            timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def execute(spark: SparkSession, sql: str, timeout: float | None = None) -> tuple[str, list]:
    """(status, rows) of a query; after timeout seconds its jobs are cancelled."""
    status, rows = within(spark, lambda: spark.sql(sql).collect(), timeout, sql)
    return status, rows or []


class CountCache:
    """Counts kept in Parquet by the SHA-1 of their SQL; only queries slower than threshold seconds are stored."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 4.0):
        self.spark, self.path, self.threshold = spark, path, threshold

    def get(self, sql: str) -> int:
        import time

        name = hashlib.sha1(sql.encode()).hexdigest()
        stored = path_exists(self.spark, self.path)
        if stored and (known := self.spark.read.parquet(self.path).where(F.col("sql_key") == name).select("value").head(1)):
            return known[0][0]
        began = time.perf_counter()
        value = self.spark.sql(sql).first()[0]
        took = time.perf_counter() - began
        if took >= self.threshold:
            row = self.spark.createDataFrame([(name, sql, value, took)], "sql_key string, sql string, value long, seconds double")
            row.write.mode("append").parquet(self.path)
        return value
