"""Counts of the sub-joins of many queries from indexed rows.

A sub-join is a set of aliases with the conditions between them. Its rows are formed once for a block of queries, whatever
their shapes, and counted in Arrow batches: every filter column is ranked, so that a filter is a set of rank intervals, and
the rows of a query are looked up at its narrowest column; only these are held against the other filters. So a query costs
the rows of its narrowest filter, not a pass over the tables, and equal filters of a sub-join are counted once.

Only sub-joins that stay in proportion to their tables are formed (Index.learn counts their rows by messages first), and only
filters are taken that mean the same here as in Spark: whole numbers and texts compared with their like, IN, BETWEEN, LIKE
without escapes, IS NULL, and OR groups of these. Index.takes tells; all other queries are counted by messages.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructType

from joinlens.operators import cards
from joinlens.operators.cards import CROSS_JOIN, OK, Loader
from joinlens.session import spread
from joinlens.workload.spec import Edge, JoinQuery, Predicate, _as_number, key

#: Rows and bytes that a task indexes at once; rows up to which a sub-join is one task; rows of a join for each of its tables' rows.
CHUNK_ROWS, CHUNK_BYTES, FEW_ROWS, WIDEST = 1 << 19, 128 << 20, 1 << 14, 4
_WHOLE = ByteType | ShortType | IntegerType | LongType
_COMPARED = ("eq", "ne", "lt", "le", "gt", "ge", "in", "not_in", "between", "not_between", "range")

Intervals = list[tuple[int, int]]


def _named(q: JoinQuery) -> dict[str, str]:
    """Names that do not depend on the choice of aliases: the table, with the alias where a table comes twice."""
    often = Counter(q.tables.values())
    return {a: table if often[table] == 1 else f"{table} {a}" for a, table in q.tables.items()}


def edge_text(e: Edge) -> str:
    """A join condition, the same whichever side comes first."""
    return min(f"{e.a}.{e.ca} {e.op} {e.b}.{e.cb}", f"{e.b}.{e.cb} {e.op} {e.a}.{e.ca}")


def _item(alias: str, p: Predicate, schema: StructType) -> tuple | None:
    """A filter as (column, op, values) or ("any", branches); column is (alias, name, how it is read). None if it is not taken."""
    if p.op == "any":
        branches = tuple(tuple(_item(alias, q, schema) for q in branch) for branch in p.values)
        return None if any(x is None for branch in branches for x in branch) else ("any", branches)
    if p.cast or p.column not in schema.names:
        return None
    kind, word, values = schema[p.column].dataType, p.op.removeprefix("not_"), p.values
    if word == "null":
        how = "whole" if isinstance(kind, _WHOLE) else "text" if kind == StringType() else "null"
        return ((alias, p.column, how), p.op, ())
    if p.op == "range":
        if values == (None, None):
            return None
        parts = [(op, v) for op, v in zip(("gt", "le"), values) if v is not None]
        both = tuple(_item(alias, Predicate(p.column, op, (v,)), schema) for op, v in parts)
        return None if None in both else ("any", (both,))
    if isinstance(kind, _WHOLE) and p.op in _COMPARED:
        values = tuple(_as_number(v) if isinstance(v, str) else v for v in values)
        return ((alias, p.column, "whole"), p.op, values) if all(type(v) is int and abs(v) < 1 << 63 for v in values) else None
    if kind != StringType() or not all(isinstance(v, str) for v in values):
        return None
    if p.op in _COMPARED:
        return ((alias, p.column, "text"), p.op, tuple(v.encode() for v in values))
    if word in ("like", "ilike") and "\\" not in values[0] and (word == "like" or values[0].isascii()):
        return ((alias, p.column, "text"), p.op, values) if word == "like" else ((alias, p.column, "lower"), p.op.replace("ilike", "like"), (values[0].lower(),))
    return None


def _union(sets: Intervals) -> Intervals:
    out: Intervals = []
    for lo, hi in sorted(sets):
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _both(a: Intervals, b: Intervals) -> Intervals:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo < hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return out


class _Column:
    """A column by ranks: null is 0, the values in order are 1, 2, ..; order has the rows by rank, first where a rank begins."""

    def __init__(self, values: pa.ChunkedArray):
        array = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
        valid = np.asarray(array.is_valid().to_numpy(zero_copy_only=False))
        if pa.types.is_integer(array.type):
            found, at = np.unique(array.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
            self.values, self.texts = found.tolist(), None
        else:
            coded = array.dictionary_encode()
            entries = coded.dictionary.cast(pa.binary()).to_pylist()
            by_value = sorted(range(len(entries)), key=entries.__getitem__)
            place = np.empty(len(entries) + 1, np.int64)
            place[by_value] = np.arange(len(entries))
            at = place[coded.indices.fill_null(len(entries)).to_numpy(zero_copy_only=False)] if entries else np.zeros(len(array), np.int64)
            self.values, self.texts = [entries[i] for i in by_value], coded.dictionary.take(pa.array(by_value, pa.int64()))
        self.rank = np.where(valid, at + 1, 0).astype(np.uint32)
        self.end = len(self.values) + 1
        self.order = np.argsort(self.rank, kind="stable")
        self.first = [0, *np.cumsum(np.bincount(self.rank, minlength=self.end)).tolist()]

    def size(self, sets: Intervals) -> int:
        return sum(self.first[hi] - self.first[lo] for lo, hi in sets)

    def _without(self, sets: Intervals) -> Intervals:
        """The other values; nulls meet neither."""
        edges = [1, *(x for pair in sets for x in pair), self.end]
        return [(lo, hi) for lo, hi in zip(edges[::2], edges[1::2]) if lo < hi]

    def intervals(self, op: str, values: tuple) -> Intervals:
        if op == "null":
            return [(0, 1)]
        if op == "not_null":
            return _union([(1, self.end)])
        if op in ("ne", "not_in", "not_between", "not_like"):
            return self._without(self.intervals("eq" if op == "ne" else op.removeprefix("not_"), values))
        if op == "like":
            return self._like(values[0])
        below, upto = (lambda v: bisect_left(self.values, v) + 1), (lambda v: bisect_right(self.values, v) + 1)
        if op in ("eq", "in"):
            return _union([(below(v), upto(v)) for v in values])
        return _union([{
            "lt": lambda: (1, below(values[0])), "le": lambda: (1, upto(values[0])), "gt": lambda: (upto(values[0]), self.end),
            "ge": lambda: (below(values[0]), self.end), "between": lambda: (below(values[0]), upto(values[1])),
        }[op]()])

    def _like(self, pattern: str) -> Intervals:
        start = pattern.rstrip("%") if pattern.endswith("%") else pattern
        if "%" not in start and "_" not in start:
            low = start.encode()
            if start == pattern:
                return self.intervals("eq", (low,))
            after = low.rstrip(b"\xff")
            end = bisect_left(self.values, after[:-1] + bytes([after[-1] + 1])) + 1 if after else self.end
            return _union([(bisect_left(self.values, low) + 1, end)])
        hits = np.flatnonzero(pc.match_like(self.texts, pattern).to_numpy(zero_copy_only=False)) if len(self.values) else np.array([], np.int64)
        runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1) if len(hits) else []
        return [(int(r[0]) + 1, int(r[-1]) + 2) for r in runs]


class _Rows:
    """Rows of a sub-join, counted by conjunctions of items."""

    def __init__(self, table: pa.Table, keys: list[tuple]):
        self.columns = {k: _Column(table.column(i)) for i, k in enumerate(keys)}
        self.met: dict[tuple, tuple | None] = {}
        self.beside: dict[tuple, np.ndarray] = {}

    def _set(self, item: tuple) -> tuple[tuple, Intervals] | None:
        """(column, intervals) of an item that is about one column."""
        if item not in self.met:
            self.met[item] = self._set_of_group(item[1]) if item[0] == "any" else (item[0], self.columns[item[0]].intervals(*item[1:]))
        return self.met[item]

    def _set_of_group(self, branches: tuple) -> tuple[tuple, Intervals] | None:
        found = [[self._set(x) for x in branch] for branch in branches]
        if any(x is None for branch in found for x in branch) or len({x[0] for branch in found for x in branch}) != 1:
            return None
        return found[0][0][0], _union([pair for branch in found for pair in reduce(_both, (x[1] for x in branch))])

    def _ranks(self, by: tuple, column: tuple) -> np.ndarray:
        """The ranks of a column in the order of another."""
        if (by, column) not in self.beside:
            self.beside[by, column] = self.columns[column].rank[self.columns[by].order]
        return self.beside[by, column]

    def _test(self, ranks: np.ndarray, column: tuple, sets: Intervals) -> np.ndarray:
        if len(sets) > 8:
            wanted = np.zeros(self.columns[column].end + 1, bool)
            for lo, hi in sets:
                wanted[lo:hi] = True
            return wanted[ranks]
        each = [(ranks - np.uint32(lo)) < np.uint32(hi - lo) for lo, hi in sets]  # what is below lo wraps around
        return reduce(np.logical_or, each) if each else np.zeros(len(ranks), bool)

    def _mask(self, item: tuple, by: tuple, part) -> np.ndarray:
        one = self._set(item)
        if one is not None:
            return self._test(self._ranks(by, one[0])[part], *one)
        return reduce(np.logical_or, (reduce(np.logical_and, (self._mask(x, by, part) for x in branch)) for branch in item[1]))

    def count(self, items: tuple) -> int:
        sets: dict[tuple, Intervals] = {}
        groups = []
        for item in items:
            one = self._set(item)
            if one is None:
                groups.append(item)
            else:
                sets[one[0]] = _both(sets[one[0]], one[1]) if one[0] in sets else one[1]
        sized = sorted((self.columns[c].size(s), c) for c, s in sets.items())
        if sized and not sized[0][0]:
            return 0
        if len(sized) == 1 and not groups:
            return sized[0][0]
        by = sized[0][1] if sized else next(iter(self.columns))
        first = self.columns[by].first
        parts = [(first[lo], first[hi]) for lo, hi in sets.get(by, [(0, self.columns[by].end)]) if first[lo] < first[hi]]
        parts = [slice(*p) for p in parts] if len(parts) < 4 else [np.concatenate([np.arange(*p) for p in parts])]
        total = 0
        for part in parts:
            tests = [self._test(self._ranks(by, c)[part], c, sets[c]) for _, c in sized[1:]] + [self._mask(g, by, part) for g in groups]
            total += int(np.count_nonzero(reduce(np.logical_and, tests)))
        return total


def _counter(number: int, keys: list[tuple], members: dict[tuple, int]):
    """A function for mapInArrow: (number, member, count) of the rows that meet each member's items; for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = _Rows(pa.Table.from_batches(held), keys)
            found = [(at, n) for items, at in members.items() if (n := rows.count(items))]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int32()), pa.array([at for at, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], ["number", "member", "n"])

        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
                yield counted(held)
                held, rows, size = [], 0, 0
        if rows:
            yield counted(held)

    return run


def _renamed(e: Edge, names: dict[str, str]) -> Edge:
    return Edge(names[e.a], e.ca, names[e.b], e.cb, e.op)


class Index:
    """The sub-joins that are formed and the counts of queries over them."""

    def __init__(self, spark: SparkSession, load: Loader):
        self.spark, self.load = spark, load
        self.schemas: dict[str, StructType] = {}
        self.rows: dict[tuple, int] = {}  # of sub-joins that may be formed, without filters
        self.seen: set[tuple] = set()
        self.known: dict[tuple, list[tuple]] = {}

    def subsets(self, q: JoinQuery) -> list[tuple]:
        """(aliases, name, sub-join) of the connected subsets; a sub-join is its tables and its conditions."""
        shape = (tuple(sorted(q.tables.items())), tuple(sorted(map(edge_text, q.edges))))
        if shape not in self.known:
            names = _named(q)
            edges = {edge_text(e): e for e in q.edges}.values()
            self.known[shape] = [
                (s, key(s), (tuple(sorted((names[a], q.tables[a]) for a in s)), tuple(sorted(edge_text(_renamed(e, names)) for e in edges if e.a in s and e.b in s))))
                for s in q.subsets()
            ]
        return self.known[shape]

    def learn(self, q: JoinQuery) -> None:
        """Count the sub-joins of a shape without filters, and keep those that are not much larger than their tables."""
        subsets = self.subsets(q)
        if {sub for *_, sub in subsets} <= self.seen:
            return
        parts, _ = cards.grouped_counts(self.load, q, False)
        found = {r["subset"]: r["value"] or 0 for r in reduce(DataFrame.unionByName, parts).select("subset", "value").collect()}
        for s, name, sub in subsets:
            self.seen.add(sub)
            if name in found and found[name] <= WIDEST * sum(found[a] for a in s) + FEW_ROWS:
                self.rows[sub] = found[name]

    def _items(self, q: JoinQuery) -> dict[str, tuple]:
        out, names = {}, _named(q)
        for a, preds in q.preds.items():
            table = q.tables[a]
            if table not in self.schemas:
                self.schemas[table] = self.load(table).schema
            out[a] = tuple(_item(names[a], p, self.schemas[table]) for p in preds)
        return out

    def takes(self, q: JoinQuery) -> bool:
        return all(sub in self.rows for *_, sub in self.subsets(q)) and all(None not in items for items in self._items(q).values())

    def _formed(self, sub: tuple, edges: list[Edge], keys: list[tuple]) -> DataFrame:
        """The rows of a sub-join: the filter columns, in the order of keys."""
        alone = {a: self.rows[((a, table),), ()] for a, table in sub[0]}
        rest, done, out = sorted(alone, key=lambda a: (-alone[a], a)), set(), None
        while rest:
            alias = next(a for a in rest if out is None or any(a in (e.a, e.b) and done & {e.a, e.b} for e in edges))
            rest.remove(alias)
            df = self.load(dict(sub[0])[alias])
            df = spread(df) if alone[alias] > FEW_ROWS else df
            read = {"whole": lambda c: F.col(c).cast("long"), "text": F.col, "lower": lambda c: F.lower(c), "null": lambda c: F.when(F.col(c).isNotNull(), F.lit(1).cast("long"))}
            joined = sorted({c for e in edges for a, c in ((e.a, e.ca), (e.b, e.cb)) if a == alias})
            df = df.select(*(F.col(c).alias(f"{alias}.{c}") for c in joined), *(read[k[2]](k[1]).alias(f"#{i}") for i, k in enumerate(keys) if k[0] == alias))
            on = [F.col(f"`{e.a}.{e.ca}`") == F.col(f"`{e.b}.{e.cb}`") for e in edges if alias in (e.a, e.b) and done & {e.a, e.b}]
            out = df if out is None else out.join(df, reduce(lambda x, y: x & y, on), "inner")
            done.add(alias)
        most = max(self.rows[sub], sum(alone.values()))
        tasks = 1 if most <= FEW_ROWS else max(self.spark.sparkContext.defaultParallelism, -(-self.rows[sub] // CHUNK_ROWS))
        return out.select(*(f"#{i}" for i in range(len(keys)))).coalesce(tasks)

    def count(self, members: list[JoinQuery]) -> pa.Table:
        """(sql_key, subset, n_tables, value, status) of queries that are taken; their qid is the key. One job."""
        formed: dict[tuple, tuple[list[Edge], dict[tuple, int]]] = {}
        wanted = []
        for q in members:
            items, names = self._items(q), _named(q)
            for s, name, sub in self.subsets(q):
                if sub not in formed:
                    formed[sub] = ([_renamed(e, names) for e in {edge_text(e): e for e in q.edges if e.a in s and e.b in s}.values()], {})
                places = formed[sub][1]
                wanted.append((q.qid, name, len(s), sub, places.setdefault(tuple(x for a in sorted(s, key=names.__getitem__) for x in items.get(a, ())), len(places))))
        parts, values = [], {sub: [0] * len(places) for sub, (_, places) in formed.items()}
        for number, (sub, (edges, places)) in enumerate(formed.items()):
            if () in places:  # no filter at all
                values[sub][places[()]] = self.rows[sub]
            filtered = {items: at for items, at in places.items() if items}
            if filtered:
                keys = sorted({k for items in filtered for k in _columns(items)})
                parts.append(self._formed(sub, edges, keys).mapInArrow(_counter(number, keys, filtered), "number int, member int, n long"))
        numbered = list(formed)
        if parts:
            for r in reduce(DataFrame.unionByName, parts).groupBy("number", "member").agg(F.sum("n").alias("n")).toArrow().to_pylist():
                values[numbered[r["number"]]][r["member"]] = r["n"]
        rows = [(qid, name, n, values[sub][at], OK) for qid, name, n, sub, at in wanted]
        for q in members:
            if not q.connected(set(q.tables)):
                rows.append((q.qid, key(tuple(q.tables)), len(q.tables), None, CROSS_JOIN))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["sql_key", "subset", "n_tables", "value", "status"])


def _columns(items: tuple) -> Iterator[tuple]:
    for item in items:
        if item[0] == "any":
            for branch in item[1]:
                yield from _columns(branch)
        else:
            yield item[0]
