"""Splits that keep related records together (problem 2): grouped iterative stratification.

Rows that share a group key (template) or the same record (canonical query), directly or through further rows, form a
component, whose rows by label are its label vector. Components are placed by iterative stratification: of the label with
the fewest rows left to place, a component with most of that label goes to the split whose outstanding need of it is
largest. Components with equal vectors are alike to this rule, so the driver sees each distinct vector once, with its
number of components, and decides how many of them go to each split; which ones, a rank within the vector tells. Vectors
come to the driver in stretches of VECTORS, largest components first, so its memory is bounded however many there are; the
rule holds within a stretch. No component is ever divided, and none is placed otherwise.

Defined cases: a row with neither key nor record is a component of its own (by row id); null labels are a label of their
own; an empty table gives an empty result; repeated rows stay together as they share their record; shares are scaled to
add up to 1; ties are broken by the need over all labels, then by the order of the splits; labels are categories: more
than MAX_LABELS distinct ones raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlens.llm.canonical import HASHES
from joinlens.llm.components import connected_components
from joinlens.operators.windows import global_rank
from joinlens.session import materialize, release

#: Distinct label vectors on the driver at a time, and labels in all.
VECTORS, MAX_LABELS = 1 << 18, 1 << 20
#: Of many equal components, at least this part is placed in one step.
STEP = 1024


def template_key(column: str | Column) -> Column:
    """The clean spelling of a category: lower-case letters and digits only; null where nothing is left."""
    name = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit(""))


def linked_keys(hashed: DataFrame, key: str) -> DataFrame:
    """(node, component): the keys linked to others because rows of both hold the same record.

    hashed has the key and the record's hashes. A record that stands under many keys links each to its smallest one, so
    edges number no more than distinct (key, record) pairs; the smallest key comes from an aggregate with map-side
    combining, and only records under two keys or more reach the join.
    """
    pairs = hashed.where(f"{key} IS NOT NULL AND hash_lo IS NOT NULL").select(*HASHES, key).distinct()
    lows = pairs.groupBy(*HASHES).agg(F.min(key).alias("v"), F.max(key).alias("__high")).where("v <> __high").drop("__high")
    return connected_components(pairs.join(lows, list(HASHES)).select(F.col(key).alias("u"), "v"))


def row_components(hashed: DataFrame, row_id: str, key: str, linked: DataFrame) -> DataFrame:
    """hashed with a column component: the smallest linked key, the key, the record or the row, in this order."""
    keyed = hashed.join(linked.select(F.col("node").alias(key), F.col("component").alias("__linked")), key, "left")
    own = F.coalesce(F.col("__linked"), F.col(key))
    of_record = (
        keyed.where("hash_lo IS NOT NULL").groupBy(*HASHES)
        .agg(F.min(own).alias("__by_record"), F.count_if(F.col(key).isNull()).alias("__keyless"))
        .where("__by_record IS NOT NULL AND __keyless > 0").drop("__keyless")
    )
    alone = keyed.where(F.col(key).isNull()).join(of_record, list(HASHES), "left")
    record = F.concat_ws("_", F.lit(" record"), *HASHES)
    rest = F.coalesce("__by_record", F.when(F.col("hash_lo").isNotNull(), record), F.concat(F.lit(" row_"), F.col(row_id).cast("string")))
    named = keyed.where(F.col(key).isNotNull()).withColumn("component", F.concat(F.lit("key_"), own)).drop("__linked")
    return named.unionByName(
        alone.withColumn("component", F.when(F.col("__by_record").isNotNull(), F.concat(F.lit("key_"), rest)).otherwise(rest)).drop("__linked", "__by_record")
    )


class Stratifier:
    """What each split still needs, by label and in all; units are placed against it.

    totals: rows by label; shares: one number a split.
    """

    def __init__(self, totals: np.ndarray, shares: np.ndarray):
        self.shares = shares / shares.sum()
        self.need = np.outer(self.shares, totals).astype(float)  # splits by labels
        self.room = self.shares * totals.sum()

    def place(self, units: list[tuple[np.ndarray, np.ndarray, int]]) -> list[list[tuple[int, int]]]:
        """[(split, number of components)...] of each unit (labels, rows of each, number of equal components)."""
        left: dict[int, float] = {}
        holders: dict[int, list[tuple[int, int]]] = {}
        for u, (labels, rows, times) in enumerate(units):
            for label, n in zip(labels.tolist(), rows.tolist(), strict=True):
                left[label] = left.get(label, 0) + n * times
                holders.setdefault(label, []).append((-n, u))
        for of in holders.values():
            of.sort()
        at = dict.fromkeys(holders, 0)
        sizes, rest = [int(rows.sum()) for _, rows, _ in units], [times for *_, times in units]
        placed: list[list[tuple[int, int]]] = [[] for _ in units]
        heap = [(n, label) for label, n in left.items()]
        heapq.heapify(heap)
        while heap:
            amount, label = heapq.heappop(heap)
            if amount != left[label]:
                if left[label] > 0:
                    heapq.heappush(heap, (left[label], label))
                continue
            of = holders[label]
            while at[label] < len(of) and rest[of[at[label]][1]] == 0:
                at[label] += 1
            if at[label] == len(of):
                continue
            each, unit = -of[at[label]][0], of[at[label]][1]
            labels, rows, _ = units[unit]
            while rest[unit]:
                split, count = self._choose(label, each, sizes[unit], rest[unit])
                rest[unit] -= count
                self.need[split, labels] -= rows * count
                self.room[split] -= sizes[unit] * count
                if placed[unit] and placed[unit][-1][0] == split:
                    placed[unit][-1] = (split, placed[unit][-1][1] + count)
                else:
                    placed[unit].append((split, count))
            for x, n in zip(labels.tolist(), rows.tolist(), strict=True):
                left[x] -= n * units[unit][2]
            if left[label] > 0:
                heapq.heappush(heap, (left[label], label))
        return placed

    def _choose(self, label: int, each: int, size: int, count: int) -> tuple[int, int]:
        """The split for the next of count equal components, and how many of them it takes before the rule looks again."""
        need, fits = self.need[:, label], np.minimum(self.room - size, 0)
        # a split that the component would overfill stands back behind one with room for it
        split = max(range(len(need)), key=lambda s: (fits[s] if fits.max() < 0 else float(fits[s] == 0), need[s], self.room[s], -s))
        rivals = [need[s] for s in range(len(need)) if s != split and fits[s] == 0]
        most = (need[split] - max(rivals)) // each + 1 if rivals else count
        if fits[split] == 0:
            most = min(most, self.room[split] // size)
        return split, int(min(count, max(most, count // STEP, 1)))


def _stretches(vectors: DataFrame) -> Iterator[list]:
    rows = vectors.toLocalIterator(prefetchPartitions=True)
    while part := list(islice(rows, VECTORS)):
        yield part


def grouped_split(hashed: DataFrame, row_id: str, key: str, label: str, shares: list[tuple[str, float]]) -> DataFrame:
    """(row id, component, split) of every row of hashed, which has row_id, key, label and the record's hashes."""
    spark = hashed.sparkSession
    hashed = hashed.select(row_id, key, label, *HASHES)
    rows = row_components(hashed, row_id, key, linked_keys(hashed, key))
    named = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")).alias("__label")
    rows = materialize(rows.select(row_id, "component", named), "split-rows")
    by_label = rows.groupBy("component", "__label").agg(F.count(F.lit(1)).alias("n"))
    vector = F.array_sort(F.collect_list(F.struct(F.col("__label").alias("label"), "n")))  # one entry a label
    parts = by_label.groupBy("component").agg(vector.alias("__vector"))
    parts = materialize(parts.withColumn("__of", F.unhex(F.md5(F.to_json("__vector")))), "split-components")
    totals = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values: stratify by a category")
    place = {name: i for i, name in enumerate(sorted(totals))}
    stratifier = Stratifier(np.array([totals[name] for name in place] or [0]), np.array([s for _, s in shares], float))
    size = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    vectors = parts.groupBy("__of").agg(F.first("__vector").alias("v"), F.count(F.lit(1)).alias("times"))
    vectors = materialize(vectors.withColumn("__size", size), "split-vectors")
    schema = "__of binary, __low long, __high long, split string"
    made = spark.createDataFrame([], schema)
    for stretch in _stretches(vectors.orderBy(F.desc("__size"), "__of")):
        units = [(np.array([place[x["label"]] for x in r["v"]]), np.array([x["n"] for x in r["v"]]), r["times"]) for r in stretch]
        chosen = []
        for r, parts_of in zip(stretch, stratifier.place(units), strict=True):
            low = 0
            for split, count in parts_of:
                chosen.append((bytes(r["__of"]), low, low + count, shares[split][0]))
                low += count
        made = made.unionByName(materialize(spark.createDataFrame(chosen, schema), "split-placed"))
    release(vectors)
    ranked = global_rank(parts.select("__of", "component"), ["__of", "component"], "__at")
    firsts = ranked.groupBy("__of").agg(F.min("__at").alias("__first"))
    number = F.col("__at") - F.col("__first")
    placed = ranked.join(firsts, "__of").join(made, "__of").where((number >= F.col("__low")) & (number < F.col("__high"))).select("component", "split")
    return rows.join(placed, "component").select(row_id, "component", "split")
