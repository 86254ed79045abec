"""Set operations and deduplication over keys and id sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlens.session import materialize


def keep_first(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each key by the order, as an aggregate with map-side combining (no sort of a hot key)."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, *(F.col(f"__first.{c}").alias(c) for c in columns))


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of several results; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def experiment_table(runs: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Rows of several runs with the run's number (experiment) and its settings as text columns, null where a run lacks one."""
    return concat([df.select(F.lit(i).alias("experiment"), *(F.lit(str(v)).alias(k) for k, v in settings.items()), "*") for i, (df, settings) in enumerate(runs)])


def common_keys(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys present in every group."""
    pairs = df.select(key, group).distinct()
    groups = pairs.agg(F.count_distinct(group).alias("__all"))  # one row
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).crossJoin(F.broadcast(groups)).where("__n = __all").select(key)


def _digest(ids: Column) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(ids.alias("s")))))


def best_overlap(probes: DataFrame, known: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, best): for each probe the largest share of its ids that one known set holds; 0 for an empty set.

    Equal sets count once on both sides. The ids of a probe that occur in known sets at all are put in order, rarest first.
    Known sets that share the first one give a bound; a set that shares none of the first m of k ids holds at most k - m, so
    only the ids up to k - bound are looked up further. Common ids are reached only where nothing better was found, so hot
    keys hardly ever meet, and the result is exact.
    """
    each = known.select(F.array_sort(F.array_distinct(F.array_compact(ids))).alias("b_ids")).where("size(b_ids) > 0")
    each = materialize(each.withColumn("b", _digest(F.col("b_ids"))).dropDuplicates(["b"]), "overlap-known")
    postings = each.select("b", F.explode("b_ids").alias("__id"))
    freq = postings.groupBy("__id").agg(F.count(F.lit(1)).alias("f"))
    keyed = probes.select(key, F.array_sort(F.array_distinct(F.array_compact(ids))).alias("a_ids"))
    keyed = keyed.withColumn("a", _digest(F.col("a_ids")))
    sets = materialize(keyed.where("size(a_ids) > 0").dropDuplicates(["a"]).select("a", "a_ids"), "overlap-probes")
    order = F.array_sort(F.collect_list(F.struct("f", "__id"))).alias("o")  # one entry an id of the set
    ordered = sets.select("a", F.explode("a_ids").alias("__id")).join(freq, "__id").groupBy("a").agg(order)
    ordered = materialize(ordered.join(sets, "a"), "overlap-ordered")

    def overlaps(looked_up: DataFrame) -> DataFrame:
        pairs = looked_up.join(postings, "__id").select("a", "b").distinct()
        met = pairs.join(sets, "a").join(each, "b").select("a", F.size(F.array_intersect("a_ids", "b_ids")).alias("c"))
        return met.groupBy("a").agg(F.max("c").alias("c"))

    first = materialize(overlaps(ordered.select("a", F.col("o")[0]["__id"].alias("__id"))), "overlap-first")
    rest = ordered.join(first, "a").where(F.size("o") - F.col("c") > 1)
    more = rest.select("a", F.explode(F.slice("o", 2, F.size("o") - F.col("c") - 1)).alias("x")).select("a", "x.__id")
    best = first.unionByName(overlaps(more)).groupBy("a").agg(F.max("c").alias("c"))
    return keyed.join(best, "a", "left").select(key, F.coalesce(F.col("c") / F.size("a_ids"), F.lit(0.0)).alias("best"))


def id_overlap_ratio(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_a, n_b, n_both and the share of a's keys that b also has."""
    sides = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    one = sides.groupBy(key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    made = one.agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"), F.sum(F.col("__a") * F.col("__b")).alias("n_both"))
    return made.withColumn("ratio", F.when(F.col("n_a") > 0, F.round(F.col("n_both") / F.col("n_a"), 6)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys of left remain."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    if not keys:
        raise ValueError("no keys: cross joins are not run")
    return left.join(renamed, on, how).drop(*(f"__right_{k}" for k in keys))
