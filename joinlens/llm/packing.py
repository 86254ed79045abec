"""Filling fixed-capacity containers (problem 8): large-item matching, then best fit into the gaps.

Only the number of items of each size reaches the driver (capacity + 1 numbers, however many items there are). There the
containers are planned for whole sizes at once: items above a third of the capacity are matched greedily, largest first
with the largest partner that fits, at most two to a container; smaller sizes, largest first, go to the fullest gap that
holds them, then to new containers. The plan is a list of segments "items a..b of size s lie, k to a container, from
container c on". Items are numbered within their size without a global sort (rank within a hash bucket plus the sizes of
the buckets before), and looked up in the segments, so assignment is one pass.

A text larger than a container is cut into full containers of its token sequence and a rest, nothing else is cut. Items
are given by token offsets (part, token_from, n_tokens of the text's ids), not by text: a cut may fall within a character.

Defined cases: null and empty texts have size 0 and are spread over the containers evenly; repeated texts and ids are items
of their own; an empty table gives no containers; ties within a size are broken by the item's id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinlens.session import materialize

#: Items of one size that are ranked in one task: there are as many hash buckets as the commonest size needs.
BUCKET_ITEMS = 1 << 16


class _Gaps:
    """Containers by free room, as runs of consecutive container numbers."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((first, count))

    def take(self, size: int, most: int) -> tuple[int, int, int] | None:
        """Up to most containers of one run with the smallest room of at least size: room, first, count."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.runs[room].pop()
        if count > most:
            self.runs[room].append((first + most, count - most))
            count = most
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(at)
        return room, first, count


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(segments, number of containers) for counts[size] items of each size up to the capacity.

    Segment rows: size, first item, number past the last item, first container, items a container.
    """
    left = [int(c) for c in counts]
    used = [0] * len(left)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps, containers = _Gaps(), 0

    def put(size: int, items: int, first: int, each: int) -> None:
        segments.append((size, used[size], used[size] + items, first, each))
        used[size] += items
        left[size] -= items

    large = [s for s in range(capacity // 3 + 1, capacity + 1) if left[s]]
    while large:
        size = large[-1]
        fits = bisect_left(large, capacity - size + 1) - 1
        while fits >= 0 and left[large[fits]] < 1 + (large[fits] == size):
            fits -= 1
        if fits < 0:
            gaps.add(capacity - size, containers, left[size])
            containers += left[size]
            put(size, left[size], containers - left[size], 1)
        else:
            other = large[fits]
            pairs = left[size] // 2 if other == size else min(left[size], left[other])
            if other == size:
                put(size, 2 * pairs, containers, 2)
            else:
                put(size, pairs, containers, 1)
                put(other, pairs, containers, 1)
            gaps.add(capacity - size - other, containers, pairs)
            containers += pairs
            if not left[other]:
                large.remove(other)
        if large and large[-1] == size and not left[size]:
            large.pop()
    for size in range(capacity // 3, 0, -1):
        while left[size]:
            found = gaps.take(size, 1 << 62)
            if found is None:
                each = capacity // size
                room, first, count = capacity, containers, -(-left[size] // each)
                containers += count
            else:
                room, first, count = found
                each = room // size
            full = min(count, left[size] // each)
            if full:
                put(size, full * each, first, each)
                gaps.add(room - each * size, first, full)
            if full < count and left[size]:
                rest = left[size]
                put(size, rest, first + full, rest)
                gaps.add(room - rest * size, first + full, 1)
                full += 1
            gaps.add(room, first + full, count - full)
    return np.array(segments, np.int64).reshape(-1, 5), containers


def token_items(sized: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """(id, part, token_from, n_tokens): whole texts, and the parts of texts larger than the capacity."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col(size) - 1, F.lit(0)) / capacity).cast("long"))
    rows = sized.select(item_id, size, F.explode(parts).alias("part"))
    start = F.col("part") * capacity
    return rows.select(item_id, "part", start.alias("token_from"), F.least(F.col(size) - start, F.lit(capacity)).alias("n_tokens"))


def pack(items: DataFrame, item_id: str, capacity: int) -> DataFrame:
    """items (id, part, token_from, n_tokens) with the container of each."""
    items = materialize(items.select(item_id, "part", "token_from", "n_tokens"), "pack-items")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in items.groupBy("n_tokens").count().collect():  # at most capacity + 1 rows
        counts[n] = c
    buckets = max(1, -(-int(counts.max()) // BUCKET_ITEMS)) * 2  # hashed, so half full on average
    items = items.withColumn("__b", F.pmod(F.xxhash64(F.lit(1), item_id, "part"), F.lit(buckets)))
    per_bucket = items.groupBy("n_tokens", "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("n_tokens").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("__offset", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    segments, containers = plan(counts, capacity)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    shared = items.sparkSession.sparkContext.broadcast((segments, max(1, containers)))
    within = Window.partitionBy("n_tokens", "__b").orderBy(item_id, "part")
    ranked = items.withColumn("__rank", F.row_number().over(within)).join(offsets, ["n_tokens", "__b"])
    ranked = ranked.select(item_id, "part", "token_from", "n_tokens", (F.col("__offset") + F.col("__rank") - 1).alias("__index"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = shared.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            size, index = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            if len(key):
                row = table[np.maximum(np.searchsorted(key, size * (1 << 44) + index, "right") - 1, 0)]
                where = np.where(size > 0, row[:, 3] + (index - row[:, 1]) // row[:, 4], index % n)
            else:
                where = index % n
            yield pa.RecordBatch.from_arrays([pa.array(where), *batch.columns[:4]], ["container", *batch.schema.names[:4]])

    id_type = items.schema[item_id].dataType.simpleString()
    return ranked.mapInArrow(run, f"container long, `{item_id}` {id_type}, part long, token_from long, n_tokens long")
