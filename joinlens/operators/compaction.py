"""Consolidation of many small files into few sorted ones, with an account of every record (problem 4).

A payload is a record if it is one complete, valid JSON object. Records are the same when their identity fields are equal
character by character; of equal ones that of the smallest file id is kept. Kept records are range-partitioned by a
clustering key: the boundaries come from a hash sample weighted by bytes, so every range holds about target_bytes, and the
key ends in the record's hash, so a hot cluster spreads over as many files as it needs. Each range is sorted and written as
one file into a staging folder. The account is checked before the staging folder takes the place of the target folder:
input files = records + copies + rejected, and row count and the sum of hashes over all columns of what was written are
those of the kept records.

Sample and boundaries are tables: the sample grows with the number of files wanted (SAMPLE_PER_FILE rows each), the driver
sees neither. Ranges are looked up in a broadcast array of at most BROADCAST_CUTS boundaries, beyond that in two steps.

Payloads are parsed once, by the built-in parser; what it refuses though it is framed as an object (longer than its limit,
a key named twice) is decided by a strict reader row by row, so that no valid record is lost.

Defined cases: null, empty, cut-off and otherwise invalid payloads hold nothing and are counted as rejected; a JSON value
that is no object is no record; of a key named twice the last value counts; white space around an object is that of JSON;
a missing identity field is null, and equal to another missing one; file ids are unique; an empty table writes one empty
file; further columns are carried along if asked for; an object nested too deep to be read raises an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators.windows import global_rank
from joinlens.session import delete_path, materialize, release, scratch_path

#: Sampled rows for each file wanted, and at least; boundaries are then off by a few per cent of a file's size.
SAMPLE_PER_FILE, SAMPLE_LEAST = 64, 10_000
#: Boundaries in one broadcast array (about 20 MB); more are looked up in two steps.
BROADCAST_CUTS = 1 << 18
_BLANK = " \t\r\n"


def _read(text: str, fields: list[str]) -> list[str | None] | None:
    """The fields of a strictly valid JSON object as texts; None if it is none."""

    def refuse(_: str) -> None:
        raise ValueError

    try:
        value = json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    found = (value.get(f) for f in fields)
    return [v if v is None or isinstance(v, str) else json.dumps(v) for v in found]


def parse_files(files: DataFrame, file_id: str, payload: str, fields: list[str], keep: list[str]) -> DataFrame:
    """(file id, keep..., fields..., __ok, __raw) of every file: whether it holds a record, and the payload where that is
    still open.

    The built-in parser stops at the end of the first value, so the text is parsed within a list and followed by its own
    hash: whatever follows the value displaces the hash.
    """
    text = F.col(payload)
    seal = F.xxhash64(text)
    framed = F.ltrim(text, F.lit(_BLANK)).startswith("{")
    whole = F.when(framed, F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), seal.cast("string"), F.lit("]"))))
    parsed = files.select(file_id, *keep, text.alias("__text"), framed.alias("__framed"), seal.alias("__seal"), whole.alias("__v"))
    ok = F.coalesce(F.expr("try_variant_get(__v, '$[1]', 'bigint')") == F.col("__seal"), F.lit(False))
    ends = F.rtrim("__text", F.lit(_BLANK)).endswith("}")
    unclear = F.col("__framed") & F.col("__v").isNull() & ends
    values = [F.when(ok, F.expr(f"try_variant_get(__v, '$[0].{f}', 'string')")).alias(f) for f in fields]
    return parsed.select(file_id, *keep, *values, ok.alias("__ok"), F.when(unclear, F.col("__text")).alias("__raw"))


def _settled(parsed: DataFrame, fields: list[str]) -> DataFrame:
    """The open rows, read by the strict reader."""
    names = parsed.drop("__raw").columns
    places = [names.index(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_read(t, fields) for t in batch.column(len(names)).to_pylist()]
            columns = list(batch.columns[: len(names)])
            for k, place in enumerate(places):
                columns[place] = pa.array([m and m[k] for m in made], pa.string())
            columns[names.index("__ok")] = pa.array([m is not None for m in made])
            yield pa.RecordBatch.from_arrays(columns, names)

    open_rows = parsed.where("__raw IS NOT NULL")
    return open_rows.select(*names, "__raw").mapInArrow(run, parsed.drop("__raw").schema)


def identity(fields: list[str]) -> Column:
    """A 192-bit identity of the fields' exact values; null is apart from any text."""
    parts = F.to_json(F.struct(*(F.col(f).alias(str(i)) for i, f in enumerate(fields))), {"ignoreNullFields": "false"})
    return F.concat(F.unhex(F.md5(parts)), F.unhex(F.lpad(F.hex(F.xxhash64(*fields)), 16, "0")))


def boundaries(sample: DataFrame, key: str, size: str, files: int) -> DataFrame:
    """(no, cut): at most files - 1 keys, numbered from 0, that cut the sample into parts of equal bytes.

    Bytes are summed up within range partitions and shifted by those before, one row a range.
    """
    from pyspark.sql import Window

    ranged = materialize(sample.select(F.col(key).alias("cut"), F.col(size).alias("__s")).repartitionByRange("cut").withColumn("__range", F.spark_partition_id()), "cuts-sample")
    sums = ranged.groupBy("__range").agg(F.sum("__s").alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    everything = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"), F.sum("__sum").over(everything).alias("__total"))
    upto = Window.partitionBy("__range").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("__upto", F.sum("__s").over(upto)).join(F.broadcast(sums), "__range")  # one row a range
    end = F.col("__base") + F.col("__upto")
    part = [F.floor(x * F.lit(files) / F.col("__total")) for x in (end - F.col("__s"), end)]
    crossing = placed.where(part[1] > part[0]).where(end < F.col("__total"))
    return global_rank(crossing.select("cut").distinct(), ["cut"], "no").select((F.col("no") - 1).alias("no"), "cut")


def _count_up_to(array: Column, key: Column) -> Column:
    """Number of values <= key in a sorted array, by binary search within the expression."""
    size = F.size(array)
    steps = F.sequence(F.lit(1), F.length(F.bin(size)))

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        right = (low < high) & (F.element_at(array, F.least(middle + 1, F.greatest(size, F.lit(1)))) <= key)
        return F.struct(F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right | (low >= high), high).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    return F.when(size == 0, 0).otherwise(F.aggregate(steps, start, halve, lambda s: s["low"]))


def with_range(rows: DataFrame, key: str, cuts: DataFrame, n_cuts: int, out: str, most: int = BROADCAST_CUTS) -> DataFrame:
    """rows with the number of cuts (no, cut) that are <= key.

    Every step-th cut lies in a broadcast single-row array of at most `most` cuts; with more cuts, those between two of
    these are met by an equality join.
    """
    if n_cuts == 0:
        return rows.withColumn(out, F.lit(0))
    step = -(-n_cuts // most)
    coarse = cuts.where(F.col("no") % step == 0).agg(F.array_sort(F.collect_list("cut")).alias("__cuts"))  # at most `most` values
    found = rows.crossJoin(F.broadcast(coarse)).withColumn("__block", _count_up_to(F.col("__cuts"), F.col(key)) - 1).drop("__cuts")
    if step == 1:
        return found.withColumn(out, (F.col("__block") + 1).cast("int")).drop("__block")
    fine = cuts.groupBy(F.floor(F.col("no") / step).cast("int").alias("__block")).agg(F.array_sort(F.collect_list("cut")).alias("__fine"))  # step values
    joined = found.join(fine, "__block", "left")
    inner = F.col("__block") * step + _count_up_to(F.coalesce("__fine", F.array().cast("array<string>")), F.col(key))
    return joined.withColumn(out, F.greatest(inner, F.lit(0)).cast("int")).drop("__block", "__fine")


def swap_directory(spark: SparkSession, staging: str, target: str) -> None:
    """Put staging in the place of target; the old target is set aside first and deleted last.

    A folder set aside by a run that broke off between the two renames is the only old copy: it is put back first.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = f"{target}.old"
    if fs.exists(path(aside)):
        if fs.exists(path(target)):
            delete_path(spark, aside)
        elif not fs.rename(path(aside), path(target)):
            raise RuntimeError(f"cannot put {aside} back")
    if fs.exists(path(target)) and not fs.rename(path(target), path(aside)):
        raise RuntimeError(f"cannot set {target} aside")
    try:
        moved = fs.rename(path(staging), path(target))
    except Exception:  # noqa: BLE001 - some stores raise where others return false
        moved = False
    if not moved:
        if fs.exists(path(aside)):
            fs.rename(path(aside), path(target))
        raise RuntimeError(f"cannot move {staging} to {target}")
    delete_path(spark, aside)


@dataclass
class Compaction:
    """What a compaction wrote: the folder, its records, the copies left out, and the account."""

    path: str
    records: DataFrame
    copies: DataFrame
    report: dict


def _account(df: DataFrame, columns: list[str], *more: Column) -> tuple:
    """Rows and the sum of hashes over all columns, beside further aggregates."""
    return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), *more).first()


def compact(
    files: DataFrame, file_id: str, payload: str, identity_fields: list[str], other_fields: list[str], cluster: Column,
    target_bytes: int = 512 << 20, target: str | None = None, keep: list[str] | None = None,
) -> Compaction:
    """Write the distinct records of files to target (default: a scratch folder) in files of about target_bytes of text.

    cluster is a text column over the fields by which near records should lie together.
    """
    spark, keep = files.sparkSession, keep or []
    fields = [*identity_fields, *other_fields]
    same = F.when(F.col("__ok"), identity(identity_fields))
    parsed = materialize(parse_files(files, file_id, payload, fields, keep).withColumn("__id", same), "compact-parsed")
    settled = parsed.drop("__raw")
    n_open = parsed.where("__raw IS NOT NULL").count()
    if n_open:
        decided = materialize(_settled(parsed.drop("__id"), fields).withColumn("__id", same), "compact-open")
        settled = parsed.where("__raw IS NULL").drop("__raw").unionByName(decided)
    size = sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields), F.lit(16)).cast("long")
    key = F.concat(F.coalesce(cluster, F.lit("")), F.lit("\x01"), F.hex("__id"))
    records = settled.where("__ok").drop("__ok").withColumn("__key", key)
    narrow = materialize(records.select(file_id, "__id", "__key", size.alias("__size")), "compact-ids")
    classes = narrow.groupBy("__id").agg(F.min(file_id).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    classes = materialize(classes, "compact-classes")
    n_surplus = classes.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]
    copies = narrow.join(classes, "__id").where(F.col(file_id) != F.col("__first"))
    copies = materialize(copies.select(F.col("__first").alias(file_id), F.col(file_id).alias(f"copy_{file_id}")), "compact-copies")
    left_out = copies.select(F.col(f"copy_{file_id}").alias(file_id))
    n_rejected, n_copies, n_input, n_seen = settled.where("NOT __ok").count(), copies.count(), files.select(file_id).count(), narrow.count()
    columns = [file_id, *keep, *fields, "__id"]
    out = records.join(left_out, file_id, "left_anti")
    n, check, text_bytes = _account(out, columns, F.coalesce(F.sum(size), F.lit(0)))
    if n_input != n + n_copies + n_rejected or n_seen != n + n_copies or n_copies != n_surplus:
        raise RuntimeError(f"{n_input} files came in, {n} records were to be kept, {n_copies} copies and {n_rejected} rejected files left out")
    wanted, n_cuts, cuts = max(1, math.ceil(text_bytes / target_bytes)), 0, None
    if wanted > 1:
        part = min(1.0, max(SAMPLE_LEAST, SAMPLE_PER_FILE * wanted) / n)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(1), file_id), 11).cast("double") / F.lit(float(2**53))
        drawn = narrow.where(u < part).join(left_out, file_id, "left_anti")
        cuts = materialize(boundaries(drawn, "__key", "__size", wanted), "compact-cuts")
        n_cuts = cuts.count()
    out = with_range(out, "__key", cuts, n_cuts, "__part").repartitionById(n_cuts + 1, F.col("__part"))
    target = target or scratch_path(spark, "compact")
    staging = f"{target}.staging"
    out.sortWithinPartitions("__key").select(*columns).write.mode("overwrite").parquet(staging)
    written = spark.read.schema(out.select(*columns).schema).parquet(staging)
    n_written, check_written, n_files = _account(written.select("*", F.col("_metadata.file_path").alias("__f")), columns, F.count_distinct("__f"))
    if (n_written, check_written) != (n, check):
        delete_path(spark, staging)
        raise RuntimeError(f"{n_written} records were written, {n} were to be kept; the target folder was left as it is")
    swap_directory(spark, staging, target)
    release(parsed, narrow, classes, *([cuts] if cuts is not None else []))
    report = {"input": n_input, "records": n, "copies": n_copies, "rejected": n_rejected, "files": n_files, "text_bytes": int(text_bytes), "target_bytes": target_bytes}
    return Compaction(target, spark.read.schema(written.schema).parquet(target).drop("__id"), copies, report)
