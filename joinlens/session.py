"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the results rely on (UTC, ANSI) or that every plan here expects (AQE with skew handling).
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "joinlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with CONF; conf overrides single settings (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_base(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where the setting is missing (tests on one machine) a temporary folder is set; a session that is not local
    must bring the setting, since a machine's own folder would not be seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + os.path.join(tempfile.gettempdir(), f"joinlens-scratch-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it comes from a few small files; else df as it is.

    For stages whose CPU work far outweighs their bytes. A table that fills a split for every core is never touched, nor are
    its files listed.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split and len(df.inputFiles()) < cores else df


_written: list[tuple[SparkSession, str]] = []
_registered: list[bool] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by clean_scratch or when the driver ends."""
    path = f"{scratch_base(spark)}/{label}-{uuid.uuid4().hex}"
    if not _registered:
        atexit.register(_clean)
        _registered.append(True)
    _written.append((spark, path))
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder through Hadoop's file system, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(target, True)


def clean_scratch(*_: object) -> None:
    """Delete all intermediates. For long-lived sessions, between queries: results that were not fetched are lost."""
    while _written:
        spark, path = _written.pop()
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


def _clean() -> None:
    clean_scratch()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete what materialize wrote, once nothing that is still to run reads it; other tables are left alone."""
    for df in tables:
        path = df.__dict__.pop("_scratch", None)
        if path:
            delete_path(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]
