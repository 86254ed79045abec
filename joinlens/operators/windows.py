"""Ranks, bins and running values over whole tables, without a window that puts all rows into one task.

Rows are range-partitioned by the order and written once; ranks and running values are computed within each range and
shifted by what the ranges before it hold, of which there is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinlens.operators.percentiles import exact_percentiles
from joinlens.session import materialize


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the number of each row in the total order, from 1; order must hold a unique column."""
    ranged = _ranged(df, order)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    within = Window.partitionBy("__range").orderBy(*order)
    ranked = ranged.withColumn("__rank", F.row_number().over(within)).join(sizes.drop("__c"), "__range")
    return ranked.withColumn(out, F.col("__before") + F.col("__rank")).drop("__range", "__rank", "__before")


def ntile_global(df: DataFrame, n: int, order: list[str], out: str) -> DataFrame:
    """ntile(n) over the total order: the first rows-modulo-n tiles hold one row more."""
    ranked = global_rank(df, order, "__at")
    total = df.count()
    size, more = divmod(total, n)
    at = F.col("__at") - 1
    longer = more * (size + 1)
    tile = F.when(at < longer, F.floor(at / (size + 1))).otherwise(F.floor((at - longer) / max(size, 1)) + more)
    return ranked.withColumn(out, (tile + 1).cast("int")).drop("__at")


def quantile_chunks(df: DataFrame, q: int, order: list[str], out: str) -> DataFrame:
    """Chunks 0..q-1 of floor(rows / q) rows of the ordered table; the rest at its end is in no chunk."""
    size = max(1, df.count() // q)
    return global_rank(df, order, "__at").withColumn(out, F.floor((F.col("__at") - 1) / size)).where(F.col(out) < q).drop("__at")


def running_max(df: DataFrame, value: str, order: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Largest value so far in the order: over all rows, or within each group of by (groups of moderate size)."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.max(value).over(w))
    ranged = _ranged(df, order)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    tops = ranged.groupBy("__range").agg(F.max(value).alias("__top")).withColumn("__before", F.max("__top").over(before)).drop("__top")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = ranged.withColumn("__now", F.max(value).over(within)).join(tops, "__range")
    return made.withColumn(out, F.greatest("__now", "__before")).drop("__range", "__now", "__before")


def qcut(df: DataFrame, value: str, bins: int, out: str) -> DataFrame:
    """Equal-frequency bins, double edges dropped: the number of edges below the value."""
    found = exact_percentiles(df, [], value, {f"q{i}": i / bins for i in range(bins + 1)})  # one row
    edges = found.select(F.array_sort(F.array_distinct(F.array(*(f"q{i}" for i in range(bins + 1))))).alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(value))).cast("long")
    return df.crossJoin(F.broadcast(edges)).withColumn(out, below).drop("__edges")


def ecdf(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, share): cumulative share of rows over equal-width bins, the last one closed."""
    limits = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))  # one row
    at = F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)
    counts = df.crossJoin(F.broadcast(limits)).groupBy(F.least(F.lit(bins - 1), at).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select("bin", F.round(F.sum("__c").over(upto) / F.sum("__c").over(everything), 6).alias("share"))


def quantile_bands(df: DataFrame, value: str, out: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """high at or above the upper percentile, low at or below the lower one, else mid."""
    cuts = exact_percentiles(df, [], value, {"__lo": low, "__hi": high}).drop("n")  # one row
    band: Column = F.when(F.col(value) >= F.col("__hi"), "high").when(F.col(value) <= F.col("__lo"), "low").otherwise("mid")
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, band).drop("__lo", "__hi")
