"""Percentiles of very large numeric columns (problem 3): dyadic Count-sketches.

Values are encoded, in order, into integers of BITS bits: sign, exponent and the upper MANTISSA bits of the double, so a
decoded value is within 2^-(MANTISSA + 1) of the original, relatively. A sketch keeps one counter table per binary
resolution of the codes (code >> level): each of the MANTISSA finest resolutions is a Count-sketch of DEPTH signed rows of
width counters, the resolution of 2^EXACT cells (sign and exponent) is counted exactly and its sums give all coarser ones.
Sketches are linear: they are merged by addition, and values are deleted by adding a sketch of negative counts. A rank is
inverted by descending from the exact resolution, one estimated count (median of the rows) a level.

Every group of any size is a sketch. Counters that are zero are not stored (pack), which changes the size, not the sketch.

The error: a Count-sketch row errs by about n / sqrt(width * cells in use) a level, the median of the rows by less, and
the levels' errors are independent, so a rank is off by rank_error * n at most, with high probability, for
width = 2^ceil(log2(WIDTH_FACTOR / rank_error)) (README: measured over all groups).

Defined cases: null and NaN are no values and are left out; infinities are ordered as the smallest and largest values;
null keys are a group of their own; rows that agree in id, keys and value are one (re-deliveries), a null id is no
identity and its rows all count; a group without values is absent; empty tables give empty sketches; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from joinlens.functions.ordered import BITS, MANTISSA, decode_array, encode
from joinlens.session import materialize

DEPTH = 5
EXACT = BITS - MANTISSA  # log2 of the cells of the exact resolution
#: Width times rank error (measured: see README).
WIDTH_FACTOR = 10
RANK_ERROR = 0.01
#: Rows of a group that one task takes; larger groups are salted.
GROUP_ROWS = 1 << 22
#: Hot groups up to this number are broadcast, more are joined.
BROADCAST_GROUPS = 1 << 16
#: Rows hashed at once, and bytes of sketches held before they are handed on.
_CHUNK, _FLUSH = 1 << 14, 1 << 23
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, (MANTISSA, DEPTH, 2), dtype=np.uint64) | np.uint64(1)


def width_for(rank_error: float) -> int:
    """Counters a row so that ranks are within rank_error of n."""
    if not 0 < rank_error < 1:
        raise ValueError("rank_error is a share between 0 and 1")
    return 1 << max(4, math.ceil(math.log2(WIDTH_FACTOR / rank_error)))


def _size(width: int) -> int:
    return (1 << EXACT) + MANTISSA * DEPTH * width


def _cells(level: int, cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter numbers within a level's table and negative signs, DEPTH by cells."""
    with np.errstate(over="ignore"):
        x = (cells.astype(np.uint64) + np.uint64(1)) * _SEEDS[level, :, :1] + _SEEDS[level, :, 1:]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    bucket = (x & np.uint64(width - 1)).astype(np.int64) + np.arange(0, DEPTH * width, width)[:, None]
    return bucket, (x >> np.uint64(63)).astype(bool)


def _updates(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(counter numbers, negative signs) of all counters that a code touches; one row per counter kind, one column per code."""
    at, minus = [(codes >> MANTISSA)[None, :]], [np.zeros((1, len(codes)), bool)]
    for level in range(MANTISSA):
        bucket, sign = _cells(level, codes >> level, width)
        at.append(bucket + (1 << EXACT) + level * DEPTH * width)
        minus.append(sign)
    return np.concatenate(at), np.concatenate(minus)


class Sketch:
    """Counters of one group: the exact resolution, then DEPTH rows for each finer one."""

    __slots__ = ("counters", "width")

    def __init__(self, width: int, counters: np.ndarray | None = None):
        self.width = width
        self.counters = np.zeros(_size(width), np.int64) if counters is None else counters

    def add(self, codes: np.ndarray, counts: np.ndarray) -> "Sketch":
        """Add counts of codes (negative ones delete)."""
        for a in range(0, len(codes), _CHUNK):
            at, minus = _updates(codes[a : a + _CHUNK].astype(np.int64), self.width)
            np.add.at(self.counters, at.ravel(), np.where(minus, -counts[a : a + _CHUNK], counts[a : a + _CHUNK]).ravel())
        return self

    def merge(self, other: "Sketch") -> "Sketch":
        if self.width != other.width:
            raise ValueError("sketches of different widths do not add up")
        self.counters += other.counters
        return self

    def total(self) -> int:
        return int(self.counters[: 1 << EXACT].sum())

    def count(self, level: int, cells: np.ndarray) -> np.ndarray:
        """Estimated counts of cells at the resolution code >> level, level < MANTISSA."""
        bucket, minus = _cells(level, cells, self.width)
        found = self.counters[bucket + ((1 << EXACT) + level * DEPTH * self.width)]
        return np.median(np.where(minus, -found, found), axis=0)

    def invert(self, ranks: np.ndarray) -> np.ndarray:
        """The codes at ranks 1..n."""
        upto = np.cumsum(self.counters[: 1 << EXACT])
        cell = np.minimum(np.searchsorted(upto, ranks), (1 << EXACT) - 1)
        inside = self.counters[cell].astype(float)
        rest = ranks - (upto[cell] - inside)
        for level in range(MANTISSA - 1, -1, -1):
            below = np.clip(self.count(level, 2 * cell), 0, inside)
            right = rest > below
            cell, rest, inside = 2 * cell + right, np.where(right, rest - below, rest), np.where(right, inside - below, below)
        return cell

    def pack(self) -> bytes:
        at = np.flatnonzero(self.counters)
        return _pack(at, self.counters[at], self.width)


_TYPES = (np.int8, np.int16, np.int32, np.int64)


def _pack(at: np.ndarray, values: np.ndarray, width: int) -> bytes:
    """Non-zero counters as bytes: head (log2 width, value type, layout), then gaps and values, or all values."""
    top = int(np.abs(values).max(initial=0))
    kind = 0 if top < 1 << 7 else 1 if top < 1 << 15 else 2 if top < 1 << 31 else 3
    head = bytes((width.bit_length() - 1, kind))
    if len(at) * 2 > _size(width):
        flat = np.zeros(_size(width), _TYPES[kind])
        flat[at] = values
        return head + b"\1" + zlib.compress(flat.tobytes(), 1)
    gaps = np.diff(at, prepend=-1) - 1
    fill = gaps // 256  # a stored zero bridges 256 counters
    if fill.any():
        spot = np.cumsum(fill + 1) - 1
        wide, out = np.full(spot[-1] + 1, 255), np.zeros(spot[-1] + 1, np.int64)
        wide[spot], out[spot] = gaps % 256, values
        gaps, values = wide, out
    body = len(gaps).to_bytes(4, "little") + gaps.astype(np.uint8).tobytes() + values.astype(_TYPES[kind]).tobytes()
    return head + b"\0" + zlib.compress(body, 1)


def unpack(packed: bytes) -> tuple[int, np.ndarray | slice, np.ndarray]:
    """(width, counter numbers, counters) of a packed sketch."""
    width, kind, dense = 1 << packed[0], _TYPES[packed[1]], packed[2]
    body = zlib.decompress(memoryview(packed)[3:])
    if dense:
        return width, slice(None), np.frombuffer(body, kind)
    n = int.from_bytes(body[:4], "little")
    at = np.cumsum(np.frombuffer(body, np.uint8, n, 4).astype(np.int64) + 1) - 1
    return width, at, np.frombuffer(body, kind, n, 4 + n)


def _runs(keys: list[pa.Array]) -> np.ndarray:
    """Starts of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        codes = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


class _Writer:
    """Finished sketches of a task, handed on in batches of bounded bytes."""

    def __init__(self, schema: StructType, n_keys: int, quantiles: list[float] | None):
        self.names, self.n_keys, self.quantiles = [f.name for f in schema], n_keys, quantiles
        self.keys: list[list[pa.Array]] = [[] for _ in range(n_keys)]
        self.n: list[int] = []
        self.made: list = []
        self.held = 0

    def add(self, keys: list[pa.Array], at: np.ndarray, values: np.ndarray, width: int) -> None:
        """One sketch; keys: arrays of length one."""
        n = int(values[: np.searchsorted(at, 1 << EXACT)].sum())
        for into, key in zip(self.keys, keys, strict=True):
            into.append(key)
        self.n.append(n)
        if self.quantiles is None:
            self.made.append(_pack(at, values, width))
            self.held += len(self.made[-1])
            return
        sketch = Sketch(width)
        sketch.counters[at] = values
        ranks = np.maximum(1, np.ceil(np.array(self.quantiles) * n - 1e-9))
        self.made.append(decode_array(sketch.invert(ranks)) if n > 0 else None)
        self.held += 64

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.n and self.held >= least:
            kind = pa.binary() if self.quantiles is None else pa.list_(pa.float64())
            keys = [pa.concat_arrays(k) for k in self.keys]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(self.n, pa.int64()), pa.array(self.made, kind)], self.names)
            self.keys, self.n, self.made, self.held = [[] for _ in range(self.n_keys)], [], [], 0


class _Grouped:
    """The sketch of the group at hand, while sorted batches go by: one array of counters, whatever the size of a group."""

    def __init__(self, writer: _Writer, width: int):
        self.writer, self.sketch = writer, Sketch(width)
        self.key: list[pa.Array] | None = None

    def start(self, key: list[pa.Array]) -> bool:
        """Go on with a group; False if another one was at hand, which is then written."""
        if self.key is not None and all(a[0].as_py() == b[0].as_py() for a, b in zip(self.key, key, strict=True)):
            return True
        self.close()
        self.key = [pa.concat_arrays([k]) for k in key]
        return False

    def close(self) -> None:
        if self.key is not None:
            at = np.flatnonzero(self.sketch.counters)
            self.writer.add(self.key, at, self.sketch.counters[at], self.sketch.width)
            self.sketch.counters[:] = 0
            self.key = None


def _with(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def _slices(starts: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, starts within) of stretches of about _CHUNK rows that end with a group or in the midst of a long one."""
    at = 0
    while at < n:
        end = min(n, at + _CHUNK)
        inner = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, end)]
        yield at, end, np.concatenate(([0], inner - at))
        at = end


def sketch_groups(
    rows: DataFrame, row_id: str, keys: list[str], value: str, rank_error: float = RANK_ERROR, sign: int = 1, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Sketches of each group: keys, part, n, sketch. Groups of more than group_rows rows come in several parts, to be added up.

    One shuffle of the rows: by keys and a part that is a hash of the row id, so that re-deliveries of a row meet in the
    task that sketches it. Sizes of groups are counted before (map-side combined); only those that need parts are looked
    up. sign = -1 gives sketches that delete the rows.
    """
    narrow = rows.select(row_id, *keys, (F.col(value) + 0.0).alias("__value")).where("__value IS NOT NULL AND NOT isnan(__value)")
    sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > group_rows)
    hot = materialize(sizes.select(*keys, F.ceil(F.col("__n") / group_rows).cast("int").alias("__parts")), "hot-groups")
    n_hot = hot.count()
    part = F.lit(0)
    if n_hot:
        renamed = hot.select(*(F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)), "__parts")
        same = [F.col(k).eqNullSafe(F.col(f"__hot_{i}")) for i, k in enumerate(keys)]
        narrow = narrow.join(F.broadcast(renamed) if n_hot <= BROADCAST_GROUPS else renamed, same, "left")
        part = F.pmod(F.xxhash64(row_id), F.coalesce("__parts", F.lit(1))).cast("int")
    coded = narrow.select(*keys, part.alias("part"), row_id, "__value", encode("__value").alias("__code"))
    n_keys, width = len(keys) + 1, width_for(rank_error)
    schema = _with(coded.select(*keys, "part").schema, "n long, sketch binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(schema, n_keys, None)
        group, last = _Grouped(writer, width), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = batch.columns[:n_keys]
            starts = _runs(columns)
            fresh = np.ones(batch.num_rows, bool)  # not a row as the one before it
            fresh[_runs([*columns, *batch.columns[n_keys : n_keys + 2]])] = False
            fresh = ~fresh | batch.column(n_keys).is_null().to_numpy(zero_copy_only=False)
            head = [c[0].as_py() for c in batch.columns[: n_keys + 2]]
            if last == head and head[n_keys] is not None:
                fresh[0] = False
            last = [c[batch.num_rows - 1].as_py() for c in batch.columns[: n_keys + 2]]
            codes = batch.column(n_keys + 2).to_numpy().astype(np.int64)
            for first, end, inner in _slices(starts, batch.num_rows):
                keep = np.flatnonzero(fresh[first:end])
                owner = np.searchsorted(inner, keep, "right") - 1
                at, minus = _updates(codes[first + keep], width)
                # counters of all groups of the stretch at once: sorted by group and counter, the sign in the lowest bit
                flat = ((owner * _size(width) + at) << 1 | minus).ravel()
                flat.sort()
                key = flat >> 1
                edges = np.flatnonzero(np.diff(key, prepend=-1))
                sums = np.add.reduceat(1 - 2 * (flat & 1), edges) * sign if len(edges) else edges
                key = key[edges]
                bounds = np.searchsorted(key, np.arange(len(inner) + 1) * _size(width))
                for g in range(len(inner)):
                    spot = first + int(inner[g])
                    a, b = bounds[g], bounds[g + 1]
                    group.start([c.slice(spot, 1) for c in columns])
                    group.sketch.counters[key[a:b] - g * _size(width)] += sums[a:b]
            yield from writer.flush(_FLUSH)
        group.close()
        yield from writer.flush()

    order = [*keys, "part"]
    return coded.repartition(*order).sortWithinPartitions(*order, row_id, "__value").mapInArrow(run, schema)


def merge_sketches(sketches: DataFrame, keys: list[str], quantiles: list[float] | None = None, fan: int = 0) -> DataFrame:
    """Sketches of fewer keys, by addition: keys, part, n, sketch; or, with quantiles, keys, n, vals (in their order).

    A task adds one sketch after another to one array, so a group may have any number of parts or days. fan > 0 first adds
    up every fan-th of a group's parts, for groups of so many parts that one task should not read them all.
    """
    if fan:
        sketches = merge_sketches(sketches.withColumn("__fan", F.pmod(F.col("part"), F.lit(fan))), [*keys, "__fan"])
    n_keys = len(keys)
    out = "n long, vals array<double>" if quantiles else "n long, sketch binary"
    narrow = sketches.select(*keys, "sketch")
    schema = _with(narrow.select(*keys).schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, group = _Writer(schema, n_keys, quantiles), None
        for batch in batches:
            columns, packed = batch.columns[:n_keys], batch.column(n_keys)
            starts = set(_runs(columns).tolist()) if batch.num_rows else ()
            for row in range(batch.num_rows):
                width, at, values = unpack(packed[row].as_py())
                if group is None:
                    group = _Grouped(writer, width)
                if width != group.sketch.width:
                    raise ValueError("sketches of different widths do not add up")
                if row in starts:
                    group.start([c.slice(row, 1) for c in columns])
                group.sketch.counters[at] += values
            yield from writer.flush(_FLUSH)
        if group is not None:
            group.close()
        yield from writer.flush()

    made = narrow.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    return made if quantiles else made.withColumn("part", F.lit(0)).select(*keys, "part", "n", "sketch")
