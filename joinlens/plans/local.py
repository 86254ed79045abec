"""Work on the plan graph of one query at a time, for all queries of a workload in one stage.

A query's graph has a few thousand edges at most, a workload has any number of queries: rows are hashed by qid once, sorted
within partitions and go through in Arrow batches, so a search over a whole workload is one shuffle whatever its depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_query(df: DataFrame, columns: list[str], make: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows (qid, *row) for each row of make(*columns of one query, as lists); schema names the columns after qid."""
    narrow = df.select("qid", *columns)
    out = StructType([narrow.schema["qid"], *StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out)
        made: list[tuple] = []
        for table in _queries(batches):
            qid = table.column(0)[0].as_py()
            made += [(qid, *row) for row in make(*(table.column(k + 1).to_pylist() for k in range(len(columns))))]
            if len(made) > 20_000:
                yield _batch(made, kinds)
                made = []
        if made:
            yield _batch(made, kinds)

    return narrow.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, out)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one query after another, from batches sorted by the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def size(subset: str) -> int:
    return subset.count(" ") + 1


def cheapest(big: list[str], small: list[str], other: list[str], cost: list[float], carried: list[list[float]]) -> dict[str, tuple]:
    """subset -> (best, small, path, sums): the level search of the cheapest left-deep plan; ties by the name of small."""
    zero = (0.0,) * len(carried)
    best: dict[str, tuple] = {}
    for at in sorted(range(len(big)), key=lambda i: size(big[i])):
        if size(big[at]) == 2:
            for name in (small[at], other[at]):
                best.setdefault(name, (0.0, None, name, zero))
        below = best.get(small[at])
        if below is None:
            continue
        total, known = cost[at] + below[0], best.get(big[at])
        if known is None or (total, small[at]) < known[:2]:
            best[big[at]] = (total, small[at], f"{below[2]} {other[at]}", tuple(c[at] + s for c, s in zip(carried, below[3], strict=True)))
    return best


def cheapest_tree(big: list[str], left: list[str], right: list[str], cost: list[float], carried: list[float]) -> dict[str, tuple]:
    """subset -> (best, tree, sum): the same over any split of a subset; ties by the tree."""
    best = {name: (0.0, name, 0.0) for subset in big for name in subset.split(" ")}
    for at in sorted(range(len(big)), key=lambda i: size(big[i])):
        a, b = best.get(left[at]), best.get(right[at])
        if a is None or b is None:
            continue
        found = (cost[at] + a[0] + b[0], f"({a[1]} {b[1]})", carried[at] + a[2] + b[2])
        if big[at] not in best or found < best[big[at]]:
            best[big[at]] = found
    return best


def largest(found: dict[str, tuple]) -> list[str]:
    top = max(map(size, found), default=0)
    return [s for s in found if size(s) == top]
