"""Exact percentiles of groups of any size.

The built-in percentile keeps all distinct values of a group in one buffer. Here values are counted by an order-preserving
code (map-side), the cells in which the wanted ranks fall are found from the counts, and only those cells' distinct values
are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinlens.functions.ordered import encode
from joinlens.operators.setops import join_null_safe
from joinlens.session import materialize


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, one column a share): linear interpolation between ranks, as in most statistics packages.

    Null and NaN values are left out; null keys are a group of their own.
    """
    v = F.col(value).cast("double")
    valid = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = valid.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")).withColumn("__code", encode("__v"))
    counts = materialize(counts, "percentile-values")
    upto = Window.partitionBy(*keys).orderBy("__code").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cells = counts.groupBy(*keys, "__code").agg(F.sum("__c").alias("__c"))
    cells = cells.withColumn("__upto", F.sum("__c").over(upto)).withColumn("n", F.sum("__c").over(whole))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q)) for q in shares.values()))))
    low = F.col("__upto") - F.col("__c")
    hit = cells.where(F.exists(ranks, lambda r: (r >= low) & (r < F.col("__upto")))).select(*keys, "__code", low.alias("__low"), "n")
    inside = join_null_safe(counts, hit, [*keys, "__code"])
    within = Window.partitionBy(*keys, "__code").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("__to", F.col("__low") + F.sum("__c").over(within)).withColumn("__from", F.col("__to") - F.col("__c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__to")), F.col("__v")))

    out = []
    for name, q in shares.items():
        exact = (F.col("n") - 1) * q
        out += [at(F.floor(exact)).alias(f"__a_{name}"), at(F.ceil(exact)).alias(f"__b_{name}")]
    made = placed.groupBy(*keys, "n").agg(*out)
    share = {name: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q) for name, q in shares.items()}
    blend = [F.when(share[x] == 0, F.col(f"__a_{x}")).otherwise(F.col(f"__a_{x}") + (F.col(f"__b_{x}") - F.col(f"__a_{x}")) * share[x]).alias(x) for x in shares]
    return made.select(*keys, "n", *blend)
