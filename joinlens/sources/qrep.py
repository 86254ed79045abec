"""Stored queries with their graphs: the normalised tables of a workload."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Numbers stored in the place of a count, and the status that they stand for.
STATUS = {150001000000: "cross_join", 150001000001: "timeout", 150001000002: "exception"}
_LEGACY = {150001000: "cross_join", 150001001: "timeout", 150001002: "exception"}
_SUBSETS = "struct<nodes: array<struct<id: array<string>, cardinality: struct<actual: bigint, expected: bigint, total: bigint>>>, adjacency: array<array<struct<id: array<string>>>>>"
_JOINS = "struct<nodes: array<struct<id: string, real_name: string, pred_cols: array<string>>>, links: array<struct<source: string, target: string, join_condition: string>>>"


def _status(value: Column) -> Column:
    out = F.lit("ok")
    for number, name in (STATUS | _LEGACY).items():
        out = F.when(value == number, name).otherwise(out)
    return F.when(value.isNull(), "missing").otherwise(out)


def sub_plans(qrep: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(qid, keep..., subset, n_tables, actual, expected, total, status) of every stored sub-plan.

    Sentinels become a status with a null actual count; rows without a readable graph have no sub-plans.
    """
    graph = qrep.select("qid", *(keep or []), F.from_json("subset_graph", _SUBSETS).alias("g"))
    nodes = graph.select("qid", *(keep or []), F.explode("g.nodes").alias("x"))
    status = _status(F.col("x.cardinality.actual"))
    return nodes.select(
        "qid", *(keep or []), F.array_join(F.array_sort("x.id"), " ").alias("subset"), F.size("x.id").alias("n_tables"),
        F.when(status == "ok", F.col("x.cardinality.actual")).alias("actual"), F.col("x.cardinality.expected").alias("expected"),
        F.col("x.cardinality.total").alias("total"), status.alias("status"),
    )


def plan_edges(qrep: DataFrame) -> DataFrame:
    """(qid, big, small, other) as stored in the adjacency lists."""
    graph = qrep.select("qid", F.from_json("subset_graph", _SUBSETS).alias("g"))
    each = graph.select("qid", F.explode(F.arrays_zip(F.col("g.nodes.id").alias("big"), F.col("g.adjacency").alias("next"))).alias("x"))
    pairs = each.select("qid", F.array_sort("x.big").alias("big"), F.explode("x.next").alias("y"))
    return pairs.select("qid", F.array_join("big", " ").alias("big"), F.array_join(F.array_sort("y.id"), " ").alias("small"), F.array_join(F.array_except("big", "y.id"), " ").alias("other"))


def join_nodes(qrep: DataFrame) -> DataFrame:
    """(qid, alias, real_name, pred_cols)."""
    graph = qrep.select("qid", F.from_json("join_graph", _JOINS).alias("g"))
    return graph.select("qid", F.explode("g.nodes").alias("x")).select("qid", F.col("x.id").alias("alias"), "x.real_name", "x.pred_cols")


def join_edges(qrep: DataFrame) -> DataFrame:
    """(qid, a1, a2, join_condition)."""
    graph = qrep.select("qid", F.from_json("join_graph", _JOINS).alias("g"))
    return graph.select("qid", F.explode("g.links").alias("x")).select("qid", F.col("x.source").alias("a1"), F.col("x.target").alias("a2"), "x.join_condition")


def long_cards(cards: DataFrame) -> DataFrame:
    """(qid, subset, kind, value): one row for each kind of count."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("value")) for k in ("actual", "expected", "total")))
    return cards.select("qid", "subset", F.explode(kinds).alias("x")).select("qid", "subset", "x.kind", "x.value").where("value IS NOT NULL")


def from_old_queries(old: DataFrame, preds: DataFrame) -> DataFrame:
    """Predicates of single-object queries (qid, alias, column, op, value) attached to their alias as lists."""
    listed = preds.groupBy("qid", "alias").agg(F.array_sort(F.collect_list(F.struct("column", "op", "value"))).alias("preds"))
    return old.join(listed, ["qid", "alias"], "left")


def json_values(df: DataFrame, row_id: str, column: str, name: str) -> DataFrame:
    """(row id, pos, value): every scalar under a key of a JSON text, at any depth, as JSON text; unreadable texts have none."""
    schema = StructType([df.schema[row_id], StructField("pos", IntegerType()), StructField("value", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, places, values = [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                try:
                    todo = [json.loads(text)] if text else []
                except ValueError:
                    todo = []
                n = 0
                while todo:
                    x = todo.pop()
                    if isinstance(x, dict):
                        if name in x and not isinstance(x[name], dict | list):
                            source.append(at)
                            places.append(n)
                            values.append(json.dumps(x[name]))
                            n += 1
                        todo += reversed(x.values())
                    elif isinstance(x, list):
                        todo += reversed(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int32())), pa.array(places, pa.int32()), pa.array(values, pa.string())], [row_id, "pos", "value"])

    return df.select(row_id, column).mapInArrow(run, schema)
