"""Quality of estimates: q-errors, their summaries, bands, overlaps and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlens.functions.scalars import qerror, signed_qerror
from joinlens.operators.percentiles import exact_percentiles
from joinlens.operators.setops import join_null_safe

#: Percentiles of the summaries.
SHARES = {"percentile:25": 0.25, "percentile:50": 0.5, "percentile:75": 0.75, "percentile:90": 0.9, "percentile:99": 0.99}


def subset_qerrors(cards: DataFrame, actual: str = "actual", estimate: str = "expected") -> DataFrame:
    """cards with signed_q and q. A query that lacks any true count is left out whole; a count of 0 counts as 1."""
    complete = cards.groupBy("qid").agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col(actual).isNotNull() & F.col(estimate).isNotNull(), 1)).alias("__k"))
    kept = cards.join(complete.where("__n = __k").select("qid"), "qid", "left_semi")
    return kept.withColumn("signed_q", signed_qerror(F.col(actual), F.col(estimate))).withColumn("q", qerror(F.col(actual), F.col(estimate)))


def per_query(errors: DataFrame) -> DataFrame:
    """(qid, mean_q, p50, p90, p95, p99)."""
    ranks = exact_percentiles(errors, ["qid"], "q", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("n")
    return errors.groupBy("qid").agg(F.avg("q").alias("mean_q")).join(ranks, "qid")


def full_queries(errors: DataFrame) -> DataFrame:
    """Errors of whole queries: the largest subset of each."""
    top = errors.groupBy("qid").agg(F.max("n_tables").alias("__top"))
    return errors.join(top, "qid").where("n_tables = __top").drop("__top")


def cube_summary(df: DataFrame, value: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, summary_type, loss, num_samples) over all, each a, each b and each pair; 'all' names a rolled-up key.

    Rows are repeated for the four groupings before any aggregate; each aggregate combines map-side.
    """
    by = by or []
    text_a, text_b = F.col(a).cast("string"), F.col(b).cast("string")
    rolled = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x in (text_a, F.lit("all")) for y in (text_b, F.lit("all"))))
    valid = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    wide = valid.select(*by, F.col(value).cast("double").alias("__v"), F.explode(rolled).alias("__g")).select(*by, F.col("__g.x").alias(a), F.col("__g.y").alias(b), "__v")
    keys = [*by, a, b]
    simple = wide.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.max("__v").alias("max"), F.min("__v").alias("min"))
    ranks = exact_percentiles(wide, keys, "__v", SHARES)
    both = join_null_safe(simple, ranks, keys)
    pairs = F.array(*(F.struct(F.lit(s).alias("summary_type"), F.col(f"`{s}`").alias("loss")) for s in ("mean", "max", "min", *SHARES)))
    return both.select(*keys, F.col("n").alias("num_samples"), F.explode(pairs).alias("__s")).select(*keys, "num_samples", "__s.summary_type", "__s.loss")


def over_under(errors: DataFrame, by: list[str]) -> DataFrame:
    """Counts and mean size of over- and underestimates."""
    over = F.col("signed_q") >= 0
    return errors.groupBy(*by).agg(
        F.count_if(over).alias("n_over"), F.count_if(~over).alias("n_under"), F.avg(F.when(over, F.col("q"))).alias("mean_over"), F.avg(F.when(~over, F.col("q"))).alias("mean_under")
    )


def ordered_label(rules: list[tuple[Column, str]], default: str = "Unknown") -> Column:
    """The label of the first rule that holds."""
    out: Column | None = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def runtime_table(runtimes: DataFrame, errors: DataFrame, key: str, timeout: float = 909.0) -> DataFrame:
    """Runs beside errors: runs that timed out or lack a time are dropped, runs of a key are averaged."""
    runs = runtimes.where(F.col("runtime").isNotNull() & ~F.isnan("runtime") & (F.col("runtime") < timeout)).distinct()
    mean = runs.groupBy(key).agg(F.avg("runtime").alias("mean_runtime"), F.count(F.lit(1)).alias("n_runs"))
    return mean.join(errors, key)


def base_table_profile(cards: DataFrame) -> DataFrame:
    """Distribution of true and estimated counts by table count, for counts above 0 and up to 5e7."""
    kept = cards.where("actual > 0 AND actual <= 50000000 AND expected > 0")
    simple = kept.groupBy("n_tables").agg(F.count(F.lit(1)).alias("n"), F.avg(F.ln("actual")).alias("mean_log_true"), F.avg(F.ln("expected")).alias("mean_log_est"))
    return simple
