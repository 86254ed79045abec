"""Column statistics of a stream of events, kept per window and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from joinlens.session import scratch_path


def windowed_stats(events: DataFrame, time: str, by: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, by, n, mean, low, high) per window; events later than `late` behind the newest are dropped."""
    w = F.window(time, window)
    made = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), by)
    made = made.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return made.select(F.col("w.start").alias("start"), by, "n", "mean", "low", "high")


def run_available(spark: SparkSession, path: str, schema: StructType, transform, keys: list[str]) -> DataFrame:
    """Run a stream over the files at path until it has caught up, and return its latest rows by keys.

    Changed rows of each batch are appended with its number; a reader takes the newest of each key, so the sink is
    idempotent under replay of a batch.
    """
    target, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/b={number}")

    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    query = transform(source).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    rows = spark.read.parquet(target).drop("b")
    rest = [c for c in rows.columns if c not in (*keys, "__batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("x")).select(*keys, "x.*")
