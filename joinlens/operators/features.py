"""Feature vectors of sub-plans: sparse rows (qid, subset, slot, value) over a layout of named slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from joinlens.functions.scalars import has_digit, log_bucket, ngrams, sha1_bucket
from joinlens.operators.windows import global_rank
from joinlens.workload.parser import UnsupportedQuery, parse

#: Kinds of filters, in the order of their one-hot slots.
OPERATORS = ("eq", "ne", "lt", "in", "not_in", "like", "not_like")


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """(column, slot): slots 0..n-1 in the order of the distinct values."""
    names = values.select(column).where(F.col(column).isNotNull()).distinct()
    return global_rank(names, [column], "slot").select(column, (F.col("slot") - 1).cast("int").alias("slot"))


def workload_filters(queries: DataFrame, qid: str, sql: str) -> DataFrame:
    """(qid, alias, pos, col, op, vals) of every filter of the query texts; col is table.column, pos counts within the alias.

    Texts outside the dialect have no filters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    read = parse(text) if text else None
                except UnsupportedQuery:
                    read = None
                seen: dict[str, int] = {}
                for p in read.preds if read else ():
                    alias, _, column = p["column"].rpartition(".")
                    alias = alias or next(iter(read.tables))
                    pos = seen[alias] = seen.get(alias, -1) + 1
                    for into, x in zip(out, (row, alias, pos, f"{read.tables.get(alias, alias)}.{column}", p["op"], p["values"]), strict=True):
                        into.append(x)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["qid", "alias", "pos", "col", "op", "vals"])

    return queries.select(F.col(qid).cast("long"), sql).mapInArrow(run, "qid long, alias string, pos int, col string, op string, vals array<string>")


def filter_stats(filters: DataFrame) -> DataFrame:
    """Statistics of the columns (as of stats.column_stats) from the constants that a workload compares them with, for
    tables that are not at hand."""
    values = filters.select(F.col("col").alias("col_name"), F.explode("vals").alias("v")).where("v IS NOT NULL").groupBy("col_name", "v").agg(F.count(F.lit(1)).alias("n"))
    number = F.col("v").try_cast("double")
    low, high = (F.when(F.count(number) == F.count("v"), f(number).cast("string")).otherwise(f("v")) for f in (F.min, F.max))
    return values.groupBy("col_name").agg(low.alias("min_value"), high.alias("max_value"), F.count(F.lit(1)).alias("num_values"))


def layout(stats: DataFrame, buckets: int = 10) -> DataFrame:
    """(col_name, kind, width, first_slot): continuous columns take 2 slots, discrete ones min(buckets, distinct)."""
    numeric = F.col("min_value").try_cast("double").isNotNull() & F.col("max_value").try_cast("double").isNotNull()
    continuous = numeric & (F.col("num_values") >= buckets)
    width = F.when(continuous, 2).otherwise(F.least(F.lit(buckets), F.col("num_values"))).cast("long")
    upto = Window.orderBy("col_name").rowsBetween(Window.unboundedPreceding, -1)  # one row a column
    made = stats.select("col_name", F.when(continuous, "range").otherwise("discrete").alias("kind"), width.alias("width"))
    return made.withColumn("first_slot", F.coalesce(F.sum("width").over(upto), F.lit(0)))


def members(cards: DataFrame) -> DataFrame:
    """(qid, subset, alias) of every sub-plan."""
    return cards.select("qid", "subset", F.explode(F.split("subset", " ")).alias("alias"))


def table_onehot(cards: DataFrame, nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sum of the member tables' one-hot vectors."""
    named = members(cards).join(nodes.select("qid", "alias", "real_name"), ["qid", "alias"]).join(vocab, "real_name")
    return named.groupBy("qid", "subset", "slot").agg(F.count(F.lit(1)).cast("double").alias("value"))


def join_onehot(cards: DataFrame, joins: DataFrame, vocab: DataFrame) -> DataFrame:
    """One-hot vectors of the joins within a sub-plan."""
    inside = joins.join(cards.select("qid", "subset", F.split("subset", " ").alias("__a")), "qid")
    inside = inside.where(F.array_contains("__a", F.col("a1")) & F.array_contains("__a", F.col("a2")))
    return inside.join(vocab, "join_condition").groupBy("qid", "subset", "slot").agg(F.count(F.lit(1)).cast("double").alias("value"))


def predicate_features(preds: DataFrame, slots: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, alias, slot, value) of the first filter of each alias: hashed buckets, or the two ends of a range scaled 0..1.

    preds: qid, alias, pos, col, op, vals; an open end takes the column's minimum or maximum.
    """
    first = preds.where("pos = 0").join(slots.withColumnRenamed("col_name", "col"), "col").join(stats.select(F.col("col_name").alias("col"), "min_value", "max_value"), "col")
    low, high = F.col("min_value").try_cast("double"), F.col("max_value").try_cast("double")

    def scaled(at: int, default):
        v = F.coalesce(F.get("vals", F.lit(at)).try_cast("double"), default)
        return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))).otherwise(0.0)

    ends = F.array(F.struct(F.lit(0).cast("long").alias("o"), scaled(0, low).alias("value")), F.struct(F.lit(1).cast("long").alias("o"), scaled(1, high).alias("value")))
    ranges = first.where("kind = 'range' AND op = 'lt'").select("qid", "alias", "first_slot", F.explode(ends).alias("x"))
    hashed = first.where("NOT (kind = 'range' AND op = 'lt')").select("qid", "alias", "first_slot", "width", F.explode("vals").alias("v")).where("v IS NOT NULL")
    hashed = hashed.select("qid", "alias", (F.col("first_slot") + F.pmod(sha1_bucket(F.col("v"), 9973), F.col("width"))).alias("slot"), F.lit(1.0).alias("value")).distinct()
    return ranges.select("qid", "alias", (F.col("first_slot") + F.col("x.o")).alias("slot"), "x.value").unionByName(hashed)


def operator_features(filters: DataFrame) -> DataFrame:
    """(qid, alias, slot, value): one-hot kind of the first filter of each alias, in the order of OPERATORS."""
    slot = F.array_position(F.array(*map(F.lit, OPERATORS)), F.col("op")) - 1
    return filters.where("pos = 0").select("qid", "alias", slot.alias("slot"), F.lit(1.0).alias("value")).where("slot >= 0")


def pattern_features(preds: DataFrame, buckets: int = 10) -> DataFrame:
    """(qid, alias, slot, value) of LIKE patterns: hashed 1- to 3-grams, then length and has-digit behind the buckets."""
    like = preds.where(F.col("op").isin("like", "not_like")).select("qid", "alias", F.get("vals", F.lit(0)).alias("v"))
    grams = like.select("qid", "alias", F.explode(F.concat(*(ngrams(F.col("v"), n) for n in (1, 2, 3)))).alias("g"))
    hashed = grams.select("qid", "alias", sha1_bucket(F.col("g"), buckets).alias("slot"), F.lit(1.0).alias("value")).distinct()
    size = like.select("qid", "alias", F.lit(buckets).cast("long").alias("slot"), F.length(F.replace("v", F.lit("%"), F.lit(""))).cast("double").alias("value"))
    digit = like.select("qid", "alias", F.lit(buckets + 1).cast("long").alias("slot"), has_digit(F.col("v")).cast("double").alias("value"))
    return hashed.unionByName(size).unionByName(digit)


def subset_sum(cards: DataFrame, per_alias: DataFrame) -> DataFrame:
    """Sub-plan vectors as the sum of their aliases' vectors."""
    return members(cards).join(per_alias, ["qid", "alias"]).groupBy("qid", "subset", "slot").agg(F.sum("value").alias("value"))


def degree_features(edges: DataFrame) -> DataFrame:
    """(qid, subset, n_in, n_out): edges into and out of every sub-plan."""
    both = edges.select("qid", F.col("big").alias("subset"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select("qid", F.col("small").alias("subset"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("qid", "subset").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def flow_features(edges: DataFrame, cost: str) -> DataFrame:
    """(qid, subset, n_tables, n_in, n_out, in_cost): degrees, and the share that the edges into a sub-plan have in the cost of
    all edges of its query."""
    into = edges.groupBy("qid", F.col("small").alias("subset")).agg(F.sum(cost).alias("__c"))
    whole = edges.groupBy("qid").agg(F.sum(cost).alias("__t"))
    made = degree_features(edges).join(into, ["qid", "subset"], "left").join(whole, "qid")
    share = F.when(F.col("__t") > 0, F.coalesce("__c", F.lit(0.0)) / F.col("__t")).otherwise(0.0)
    return made.select("qid", "subset", F.size(F.split("subset", " ")).alias("n_tables"), "n_in", "n_out", share.alias("in_cost"))


def estimate_features(cards: DataFrame) -> DataFrame:
    """(qid, subset, n_tables, log_est, est_share, bucket): scaled planner estimate and its power-of-ten bucket."""
    est = F.greatest(F.col("expected").cast("double"), F.lit(1.0))
    share = F.least(F.lit(1.0), est / F.greatest(F.col("total").cast("double"), F.lit(1.0)))
    return cards.select("qid", "subset", "n_tables", F.ln(est).alias("log_est"), share.alias("est_share"), log_bucket(est, 10.0, 10).alias("bucket"))


def neighbour_features(cards: DataFrame, joins: DataFrame) -> DataFrame:
    """(qid, subset, n_neighbours): tables that a join links to a sub-plan from outside."""
    both = joins.select("qid", F.col("a1").alias("alias"), F.col("a2").alias("other")).unionByName(joins.select("qid", F.col("a2").alias("alias"), F.col("a1").alias("other")))
    near = members(cards).join(both, ["qid", "alias"]).where(~F.array_contains(F.split("subset", " "), F.col("other")))
    counts = near.groupBy("qid", "subset").agg(F.count_distinct("other").alias("n_neighbours"))
    return cards.select("qid", "subset").join(counts, ["qid", "subset"], "left").select("qid", "subset", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def log_target(value, low: float, high: float):
    """The target of a model: the logarithm scaled to 0..1 between the logarithms of low and high."""
    return (F.ln(F.greatest(value.cast("double"), F.lit(1.0))) - low) / (high - low)


def combined(plans: DataFrame, nodes: DataFrame, joins: DataFrame, filters: DataFrame, buckets: int = 4) -> tuple[DataFrame, int]:
    """(sparse rows, width) of sub-plans: tables, joins, kinds of filters, filter slots, pattern slots, then the number of
    tables, the scaled planner estimate, its share of the total and the total."""
    tables, links = vocabulary(nodes, "real_name"), vocabulary(joins, "join_condition")
    found = filter_stats(filters)
    slots = layout(found, buckets)
    widths = (tables.count(), links.count(), len(OPERATORS), slots.agg(F.coalesce(F.sum("width"), F.lit(0))).first()[0], buckets + 2)
    blocks = (
        table_onehot(plans, nodes, tables), join_onehot(plans, joins, links), subset_sum(plans, operator_features(filters)),
        subset_sum(plans, predicate_features(filters, slots, found)), subset_sum(plans, pattern_features(filters.where("pos = 0"), buckets)),
    )
    at, out = 0, None
    for width, block in zip(widths, blocks, strict=True):
        moved = block.select("qid", "subset", (F.col("slot") + at).cast("int").alias("slot"), "value")
        out, at = moved if out is None else out.unionByName(moved), at + width
    est, total = (F.greatest(F.col(c).cast("double"), F.lit(1.0)) for c in ("expected", "total"))
    scalars = [F.col("n_tables") / 10, F.ln(est) / 25, F.least(F.lit(1.0), est / total), F.ln(total) / 25]
    each = F.explode(F.array(*(F.struct(F.lit(at + i).alias("slot"), x.cast("double").alias("value")) for i, x in enumerate(scalars))))
    return out.unionByName(plans.select("qid", "subset", each.alias("x")).select("qid", "subset", "x.slot", "x.value")), at + len(scalars)


def set_features(plans: DataFrame, nodes: DataFrame, joins: DataFrame, filters: DataFrame, buckets: int = 10) -> tuple[DataFrame, dict[str, int]]:
    """(qid, subset, tables, joins, filters, scalars) of sub-plans as sets of elements, and the widths of their one-hot parts.

    tables and joins: arrays of slots; filters: array of (column, operator, hashed value, low, high), one a filter.
    """
    tables, links = vocabulary(nodes, "real_name"), vocabulary(joins, "join_condition")
    columns = vocabulary(filters.select("col"), "col")
    found = filter_stats(filters)
    low, high = F.col("min_value").try_cast("double"), F.col("max_value").try_cast("double")

    def scaled(at: int, default: float):
        v = F.get("vals", F.lit(at)).try_cast("double")
        return F.when((F.col("op") == "lt") & (high > low) & v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))).otherwise(default)

    op = F.greatest(F.array_position(F.array(*map(F.lit, OPERATORS)), F.col("op")) - 1, F.lit(0)).cast("int")
    hashed = F.pmod(F.xxhash64("vals"), F.lit(buckets)).cast("int")
    rows = filters.join(columns, "col").join(found.withColumnRenamed("col_name", "col"), "col")
    rows = rows.select("qid", "alias", F.struct(F.col("slot").alias("c"), op.alias("o"), hashed.alias("h"), scaled(0, 0.0).alias("lo"), scaled(1, 1.0).alias("hi")).alias("f"))
    inner = members(plans)

    def gathered(df: DataFrame, value: str, out: str) -> DataFrame:
        return df.groupBy("qid", "subset").agg(F.array_sort(F.collect_list(value)).alias(out))  # elements of one sub-plan

    t = gathered(inner.join(nodes.select("qid", "alias", "real_name"), ["qid", "alias"]).join(tables, "real_name"), "slot", "tables")
    j = joins.join(plans.select("qid", "subset", F.split("subset", " ").alias("__a")), "qid").where(F.array_contains("__a", F.col("a1")) & F.array_contains("__a", F.col("a2")))
    j = gathered(j.join(links, "join_condition"), "slot", "joins")
    f = gathered(inner.join(rows, ["qid", "alias"]), "f", "filters")
    est, total = (F.greatest(F.col(c).cast("double"), F.lit(1.0)) for c in ("expected", "total"))
    scalars = F.array((F.col("n_tables") / 10).cast("double"), F.ln(est) / 25, F.least(F.lit(1.0), est / total), F.ln(total) / 25)
    made = plans.select("qid", "subset", scalars.alias("scalars"))
    for part in (t, j, f):
        made = made.join(part, ["qid", "subset"], "left")
    return made, {"tables": tables.count(), "joins": links.count(), "columns": columns.count(), "operators": len(OPERATORS), "hashes": buckets, "scalars": 4}


def dense(vectors: DataFrame, width: int) -> DataFrame:
    """Sparse rows as one array a sub-plan; slots are filled batch by batch."""
    listed = vectors.groupBy("qid", "subset").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("value").cast("double").alias("value"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            table = np.zeros((batch.num_rows, width))
            table[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))], ["qid", "subset", "features"])

    schema = listed.select("qid", "subset").schema.add("features", ArrayType(DoubleType()))
    return listed.mapInArrow(run, schema)
