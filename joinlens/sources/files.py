"""Files: delimited text with repairs, fixed-length binary, results, SQL scripts and query caches; synthetic tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_name(name: str, at: int) -> str:
    """Lower case, blanks to underscores; a name that is a number becomes col<at>."""
    name = name.strip().lower().replace(" ", "_")
    return f"col{at}" if name.isdigit() or not name else name


def read_delimited(spark: SparkSession, path: str, separator: str = ",", header: bool = True, account: dict[str, int] | None = None) -> DataFrame:
    """Delimited text with repaired names and types.

    By name: *date* becomes epoch nanoseconds, *time* nanoseconds of the day. Any other column is numeric if its first value
    is (or, where that is missing, if all are), of whole numbers if all its numbers are; text in it becomes null, and account,
    if given, receives the number of such values by column. One pass decides for all columns.
    """
    raw = spark.read.csv(path, sep=separator, header=header, inferSchema=False)
    tests = []
    for at, c in enumerate(raw.columns):
        value = F.trim(F.col(f"`{c}`"))
        tests += [F.count(value).alias(f"n{at}"), F.count(value.try_cast("double")).alias(f"d{at}"), F.count_if(value.rlike(r"^[+-]?\d{1,18}$")).alias(f"i{at}")]
    seen, first = raw.agg(*tests).first(), (raw.head(1) or [None])[0]
    made = []
    for at, c in enumerate(raw.columns):
        name, value = clean_name(c if header else str(at), at), F.col(f"`{c}`")
        n, numbers, whole = (seen[f"{k}{at}"] for k in "ndi")
        if "date" in name:
            column = (F.unix_micros(F.try_to_timestamp(value)) * 1000).cast("long")
        elif "time" in name:
            parts = [F.split(value, ":").getItem(i).try_cast("double") for i in range(3)]
            column = ((parts[0] * 3600 + parts[1] * 60 + F.coalesce(parts[2], F.lit(0.0))) * 1e9).cast("long")
        elif n and (numbers == n if first[at] is None else _is_number(first[at])):
            column = F.trim(value).try_cast("long" if whole == numbers else "double")
            if account is not None:
                account[name] = n - numbers
        else:
            column = value
        made.append(column.alias(name))
    return raw.select(*made)


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def load_once(spark: SparkSession, table: str, make) -> DataFrame:
    """The table of that name; made and saved only if it does not exist."""
    if not spark.catalog.tableExists(table):
        make().write.saveAsTable(table)
    return spark.table(table)


def _file_lengths(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of the files of a folder, in whatever store it lies; hidden files are left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return [(x.getPath().toString(), x.getLen()) for x in found if x.isFile() and x.getPath().getName()[0] not in "._"]


def read_int64_records(
    spark: SparkSession, path: str, fields: int = 6, names: tuple[str, ...] = ("c0", "c1", "c2", "d0", "d1"), skip: int = 1, split_bytes: int = 64 << 20
) -> DataFrame:
    """Rows of fixed-length little-endian int64 records, without the first `skip` fields.

    Files are cut into splits of whole records; a task reads a split at once, into arrays.
    """
    width = 8 * fields
    split = max(1, split_bytes // width) * width
    files = _file_lengths(spark, path)
    if broken := [name for name, length in files if length % width]:
        raise ValueError(f"no whole number of records of {width} bytes: {broken[0]}")
    rows = [(name, start, min(split, length - start)) for name, length in files for start in range(0, length, split)]
    splits = spark.createDataFrame(rows, "path string, start long, n long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, start, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, inner = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                with store.open_input_file(inner) as file:
                    table = np.frombuffer(file.read_at(n, start), "<i8").reshape(-1, fields)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, skip + i])) for i in range(len(names))], list(names))

    return splits.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def gaussian_table(spark: SparkSession, rows: int, columns: int, least_correlation: float = 0.1, period: int = 10, seed: int = 0) -> DataFrame:
    """(id, col0..) of correlated normal values rounded to integers; every row follows from its id and the seed."""
    rng = np.random.default_rng(seed)
    mean, sd = rng.uniform(0, period * 10, columns), rng.uniform(1, period, columns)
    corr = np.eye(columns)
    for i in range(columns):
        for j in range(i):
            corr[i, j] = corr[j, i] = rng.uniform(least_correlation, 1)
    values, vectors = np.linalg.eigh(corr)
    corr = (vectors * np.maximum(values, 1e-6)) @ vectors.T
    mix = np.linalg.cholesky(corr / np.sqrt(np.outer(np.diag(corr), np.diag(corr))))

    def uniform(at: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(at), "id"), 11).cast("double") + 0.5) / float(2**53)

    ids = spark.range(rows)
    normal = [F.sqrt(-2 * F.ln(uniform(2 * i))) * F.cos(2 * np.pi * uniform(2 * i + 1)) for i in range(columns)]
    base = ids.select("id", *(n.alias(f"__z{i}") for i, n in enumerate(normal)))
    mixed = [F.round(sum((F.col(f"__z{j}") * float(mix[i, j]) for j in range(i + 1)), F.lit(0.0)) * float(sd[i]) + float(mean[i])).cast("long") for i in range(columns)]
    return base.select("id", *(m.alias(f"col{i}") for i, m in enumerate(mixed)))


def write_results(df: DataFrame, path: str, kind: str = "parquet", append: bool = True) -> None:
    """Results as Parquet or |-separated text, appended to what is there or, once they are complete, in its place."""
    from joinlens.operators.compaction import swap_directory

    to = path if append else f"{path}.staging"
    writer = df.write.mode("append" if append else "overwrite")
    writer.parquet(to) if kind == "parquet" else writer.option("header", True).option("sep", "|").csv(to)
    if not append:
        swap_directory(df.sparkSession, to, path)


def read_results(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, sep="|", header=True, inferSchema=True)


def dump_sql(queries: DataFrame, path: str) -> None:
    """Query texts, one a line with blanks for line ends, as text files."""
    queries.select(F.regexp_replace("sql", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def merge_caches(caches: list[DataFrame], key: str, text: str) -> DataFrame:
    """(key, texts): all distinct texts of each key over several runs."""
    from joinlens.operators.setops import concat

    return concat(caches).select(key, text).distinct().groupBy(key).agg(F.array_sort(F.collect_set(text)).alias("texts"))


