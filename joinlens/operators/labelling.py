"""From query texts to the counts of all their sub-joins, for whole workloads.

Texts are parsed where they lie and sorted by shape (tables and join conditions). Where a shape has more texts than a batch,
the rows of its sub-joins are formed and indexed once for a block of thousands of queries, of all shapes that share them
(operators.indexed). What the index does not take is counted by messages, queries of one shape together, batch by batch: every
table is read once a batch, its rows are marked with the queries whose filters they meet, and the counts of all sub-joins of
all these queries come out of one pass of messages along the join tree (operators.cards). Units of work run side by side.

Defined cases: a text outside the dialect has status unsupported, one over tables that are not at hand missing_table; the
whole of a query that is a cross join has status cross_join and is never run; a block that exceeds the timeout is run again
batch by batch, a batch query by query, and what still exceeds it has status timeout; null texts are left out; equal texts
are counted once.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators import cards
from joinlens.operators.cards import CROSS_JOIN, OK, TIMEOUT, Loader
from joinlens.operators.indexed import Index, edge_text
from joinlens.session import materialize, path_exists, scratch_path
from joinlens.workload.parser import UnsupportedQuery, to_query
from joinlens.workload.spec import JoinQuery, key

UNSUPPORTED, MISSING, ZERO = "unsupported", "missing_table", "zero"
#: Queries that share one index, at most; what the driver holds of them is a few dozen MB.
BLOCK = 1 << 15
_COLUMNS = "sql_key string, subset string, n_tables int, value long, status string"


def read_texts(rows: DataFrame, sql: str, tables: set[str]) -> DataFrame:
    """(sql_key, sql, shape, query, status) of the distinct texts of a column; query is the JoinQuery, pickled."""
    known = frozenset(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, queries, states = [], [], []
            for text in batch.column(1).to_pylist():
                try:
                    q = to_query(text, "")
                    shapes.append(f"{sorted(q.tables.items())} {sorted(map(edge_text, q.edges))}")
                    queries.append(pickle.dumps(q))
                    states.append(OK if set(q.tables.values()) <= known else MISSING)
                except UnsupportedQuery:
                    shapes.append(None)
                    queries.append(None)
                    states.append(UNSUPPORTED)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.string()), pa.array(queries, pa.binary()), pa.array(states, pa.string())], ["sql_key", "sql", "shape", "query", "status"])

    texts = rows.where(F.col(sql).isNotNull()).select(F.sha1(F.col(sql).cast("binary")).alias("sql_key"), F.col(sql).alias("sql"))
    return texts.dropDuplicates(["sql_key"]).mapInArrow(run, "sql_key string, sql string, shape string, query binary, status string")


def count_batch(spark: SparkSession, load: Loader, members: list[JoinQuery]) -> DataFrame:
    """(sql_key, subset, n_tables, value, status) of queries of one shape; their qid is the key."""
    shape = members[0]
    subsets = shape.subsets()
    parts, rest = cards.grouped_counts(load, shape, True, members)
    for at, member in enumerate(members):
        for s in rest:
            one = cards._one_count(load, member, s, True)
            parts.append(one.select(F.lit(at).alias("__q"), F.lit(key(s)).alias("subset"), F.lit(len(s)).alias("n_tables"), "value"))
    found = reduce(DataFrame.unionByName, parts).select("__q", "subset", "value")
    rows = [(at, m.qid, key(s), len(s)) for at, m in enumerate(members) for s in subsets]
    every = spark.createDataFrame(rows, "__q int, sql_key string, subset string, n_tables int")
    made = every.join(F.broadcast(found), ["__q", "subset"], "left")  # as many rows as `every`
    made = made.select("sql_key", "subset", "n_tables", F.coalesce("value", F.lit(0)).cast("long").alias("value"), F.lit(OK).alias("status"))
    full = tuple(sorted(shape.tables))
    return made if shape.connected(set(full)) else made.unionByName(_stated(spark, members, [full], CROSS_JOIN))


def _stated(spark: SparkSession, members: list[JoinQuery], subsets: list[tuple[str, ...]], status: str) -> DataFrame:
    return spark.createDataFrame([(m.qid, key(s), len(s), None, status) for m in members for s in subsets], _COLUMNS)


def _units(texts: DataFrame, index: Index, size: int) -> Iterator[tuple[bool, list[JoinQuery]]]:
    """(indexed, queries): blocks of queries of any shape that the index takes, batches of one shape of the others."""
    block: list[JoinQuery] = []
    slow: list[JoinQuery] = []
    shape = None
    for r in texts.select("shape", "sql_key", "query").orderBy("shape", "sql_key").toLocalIterator():
        if slow and r["shape"] != shape:
            yield False, slow.copy()
            slow.clear()
        shape, q = r["shape"], replace(pickle.loads(r["query"]), qid=r["sql_key"])
        indexed = index.takes(q)
        part = block if indexed else slow
        part.append(q)
        if len(part) == (BLOCK if indexed else size):
            yield indexed, part.copy()
            part.clear()
    for indexed, part in ((False, slow), (True, block)):
        if part:
            yield indexed, part


def _index(spark: SparkSession, load: Loader, texts: DataFrame, size: int) -> Index:
    """An index of the sub-joins of all shapes with more texts than one batch."""
    index = Index(spark, load)
    shapes = texts.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("query").alias("query")).where(F.col("n") > size)
    for q in sorted((pickle.loads(r["query"]) for r in shapes.select("query").collect()), key=lambda q: -len(q.tables)):
        index.learn(q)
    return index


def _by_batch(members: list[JoinQuery], size: int) -> Iterator[list[JoinQuery]]:
    shapes = defaultdict(list)
    for q in members:
        shapes[tuple(sorted(q.tables.items())), tuple(sorted(map(edge_text, q.edges)))].append(q)
    for of_shape in map(iter, shapes.values()):
        while part := list(islice(of_shape, size)):
            yield part


def label_workload(
    spark: SparkSession, load: Loader, texts: DataFrame, batch: int = 32, threads: int = 4, timeout: float | None = None,
    skip_zero: bool = False, cache: str | None = None,
) -> DataFrame:
    """(sql_key, subset, n_tables, value, status) of every connected sub-join of the texts (of read_texts).

    cache: a folder of earlier results; only texts that it lacks are counted, and added to it. Timeouts are not kept.
    skip_zero leaves out queries of which a sub-join is empty. Texts that are not run have one row without a subset.
    """
    texts = materialize(texts, "label-texts")
    usable = texts.where(F.col("status") == OK)
    known = _cached(spark, cache)
    todo = usable.join(known.select("sql_key").distinct(), "sql_key", "left_anti") if known is not None else usable
    path = scratch_path(spark, "labels")

    def write(members: list[JoinQuery], name: str, indexed: bool = False) -> str:
        count = (lambda: spark.createDataFrame(index.count(members))) if indexed else (lambda: count_batch(spark, load, members))
        work = lambda: count().coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        return cards.within(spark, work, timeout, f"labels {name}")[0]

    def run(name: str, members: list[JoinQuery], indexed: bool) -> None:
        if write(members, name, indexed) == OK:
            return
        if indexed:
            for at, part in enumerate(_by_batch(members, batch)):
                run(f"{name}.{at}", part, False)
            return
        for one, member in enumerate(members):
            alone = f"{name}-{one}"
            if len(members) == 1 or write([member], alone) == TIMEOUT:
                _stated(spark, [member], member.subsets(), TIMEOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/{alone}")

    index = _index(spark, load, todo, batch)
    with ThreadPoolExecutor(threads) as pool:
        waiting: list = []
        ran = False
        for at, (indexed, members) in enumerate(_units(todo, index, batch)):
            ran = True
            waiting.append(pool.submit(run, f"part={at}", members, indexed))
            while len(waiting) > (0 if indexed else 2 * threads):  # units are fetched as they are needed; the driver holds one block
                waiting.pop(0).result()
        for future in waiting:
            future.result()
    new = spark.read.schema(_COLUMNS).option("recursiveFileLookup", True).parquet(path) if ran else spark.createDataFrame([], _COLUMNS)
    found = new
    if cache:
        new.where(F.col("status") != TIMEOUT).write.mode("append").parquet(cache)
        if known is not None:
            found = found.unionByName(known.join(usable.select("sql_key"), "sql_key", "left_semi"))
    if skip_zero:
        found = found.join(found.where("value = 0").select("sql_key").distinct(), "sql_key", "left_anti")
    rest = texts.where(F.col("status") != OK).selectExpr("sql_key", "CAST(NULL AS STRING) AS subset", "CAST(NULL AS INT) AS n_tables", "CAST(NULL AS BIGINT) AS value", "status")
    return found.unionByName(rest)


def _cached(spark: SparkSession, cache: str | None) -> DataFrame | None:
    if not cache or not path_exists(spark, cache):
        return None
    return materialize(spark.read.schema(_COLUMNS).parquet(cache), "label-cache")
