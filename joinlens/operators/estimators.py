"""Size estimators by name. Each takes the counts (qid, subset, n_tables, actual, expected, total) and gives (qid, subset, est)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinlens.functions.scalars import floored


def _uniform(seed: int, *more: str) -> Column:
    """A number in [0, 1) by the row's identity."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "qid", "subset", *more), 11).cast("double") / float(2**53)


def _out(cards: DataFrame, est: Column) -> DataFrame:
    return cards.select("qid", "subset", est.alias("est"))


def planner(cards: DataFrame) -> DataFrame:
    """The stored planner estimate."""
    return _out(cards, F.col("expected").cast("double"))


def true(cards: DataFrame) -> DataFrame:
    return _out(cards, F.col("actual").cast("double"))


def random(cards: DataFrame, seed: int = 0) -> DataFrame:
    """A uniform share of the unfiltered size."""
    return _out(cards, _uniform(seed) * F.col("total"))


def true_random(cards: DataFrame, percent: float = 50.0, seed: int = 0) -> DataFrame:
    """The true count, off by up to percent in either direction; 1 at least."""
    noise = (2 * _uniform(seed) - 1) * percent / 100
    return _out(cards, floored(F.col("actual") * (1 + noise)))


def true_rank(cards: DataFrame) -> DataFrame:
    """The planner's estimates made monotone in the true order of a query's sub-plans."""
    w = Window.partitionBy("qid").orderBy("actual", "subset").rowsBetween(Window.unboundedPreceding, 0)  # sub-plans of one query
    return _out(cards, F.max("expected").over(w).cast("double"))


def true_rank_tables(cards: DataFrame) -> DataFrame:
    """true_rank within sub-plans of as many tables."""
    w = Window.partitionBy("qid", "n_tables").orderBy("actual", "subset").rowsBetween(Window.unboundedPreceding, 0)
    return _out(cards, F.max("expected").over(w).cast("double"))


def independent(cards: DataFrame) -> DataFrame:
    """The unfiltered size times the selectivities of the single tables, as if they were independent."""
    single = cards.where("n_tables = 1").select("qid", F.col("subset").alias("__a"), F.least(F.lit(1.0), floored(F.col("actual")) / floored(F.col("total"))).alias("__s"))
    parts = cards.select("qid", "subset", "total", F.explode(F.split("subset", " ")).alias("__a"))
    logs = parts.join(single, ["qid", "__a"]).groupBy("qid", "subset", "total").agg(F.sum(F.ln("__s")).alias("__l"))
    return logs.select("qid", "subset", floored(F.col("total") * F.exp("__l")).alias("est"))


def stored(cards: DataFrame, column: str) -> DataFrame:
    """A stored sampled count or one of an older database; 0 counts as 1."""
    return _out(cards, floored(F.col(column)))


def saved(cards: DataFrame, predictions: DataFrame) -> DataFrame:
    """Saved predictions (qid, subset, est); where one is missing the planner's estimate, else 1."""
    joined = cards.join(predictions.withColumnRenamed("est", "__p"), ["qid", "subset"], "left")
    return _out(joined, F.coalesce(F.col("__p"), F.col("expected").cast("double"), F.lit(1.0)))


def true_if_pattern(cards: DataFrame, has_pattern: str) -> DataFrame:
    """The true count where the sub-plan has a pattern filter, else the planner's."""
    return _out(cards, F.when(F.col(has_pattern), F.col("actual")).otherwise(F.col("expected")).cast("double"))


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "postgres": planner, "true": true, "random": random, "true_random": true_random, "true_rank": true_rank, "true_rank_tables": true_rank_tables,
    "independent": independent, "sampling": stored, "olddb": stored, "saved": saved, "regex": true_if_pattern,
}


def estimate(name: str, cards: DataFrame, **options) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {', '.join(ESTIMATORS)}")
    return ESTIMATORS[name](cards, **options)
