"""Samples whose category shares match targets (problem 1).

Per mix: cell weights (category by each further margin) are raked by iterative proportional fitting until the category
shares meet the targets and every further margin keeps the shares that it has among the rows of the mix's categories, as
far as the cells allow; no weight exceeds 1. Every row gets an exponential key -ln(u) / -ln(1 - weight) from a hash of its
id, so a draw is reproducible and needs no driver. Each category takes the smallest keys up to its quota. Quotas: the shares of the sample by largest
remainders; repaired by lifting to the minimums and cutting to the rows at hand; then what is missing goes to categories
with rows left, what is too much is taken from categories above their minimum that have rows left, by their targets. So
the sample has its size wherever rows suffice. Two reports give what remains: per category and per margin value.

The cut of a category is found without sorting it in one task: keys fall into log-scaled buckets, bucket counts (an
aggregate with map-side combining) tell the bucket where the quota ends, buckets below it are taken whole and only the rows
of that one bucket are ranked.

Defined cases: rows without a category are in no mix and count in no total; a category without rows has 0 at hand; null
margin values are a value of their own; repeated rows with one id draw together in the order of their row hash; empty
tables give an empty sample and a report of unmet targets; columns of the caller are passed by name only; minimums that add
up to more than the sample make it larger; contradicting margins end with a fit_error above 0 in the report.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from joinlens.session import materialize, release

#: Buckets for each unit of ln(key): one bucket holds under 0.04 % of the keys of any category.
FINE = 1024


def rake(counts: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Weights by cell, at most 1, so that counts * weights has the target sums of each margin, and the relative error left.

    margins: (index of the cell in the margin, target sums). A margin value without rows is left out; the last margin of
    a round is the one met exactly.
    """
    fitted, worst = counts.astype(float).copy(), 0.0
    for _ in range(rounds):
        worst = 0.0
        for index, target in margins:
            now = np.bincount(index, fitted, len(target))
            ratio = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(ratio[now > 0] - 1).max(initial=0)))
            fitted = np.minimum(fitted * ratio[index], counts)
        if worst < tolerance:
            break
    return np.divide(fitted, counts, out=np.zeros_like(fitted), where=counts > 0), worst


def _spread(amount: int, weight: np.ndarray, most: np.ndarray) -> np.ndarray:
    """amount, or as much as most allows, by weight in whole numbers: largest remainders, again until nothing is left."""
    given = np.zeros(len(weight), np.int64)
    while amount > 0:
        open_ = (given < most) & (weight > 0)
        if not open_.any():
            break
        exact = np.where(open_, weight, 0) / weight[open_].sum() * amount
        step = np.floor(exact + 1e-9).astype(np.int64)
        order = np.argsort(-np.where(open_, exact - step, -1), kind="stable")
        step[order[: amount - int(step.sum())]] += 1
        step = np.where(open_, np.minimum(step, most - given), 0)
        given += step
        amount -= int(step.sum())
    return given


def quotas(target: np.ndarray, total: int, at_hand: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows to draw of each category: shares by largest remainders, minimums and rows at hand, then the sum repaired.

    A category that gives all its rows keeps them: what it lacks is the report's business.
    """
    far = np.full(len(target), np.iinfo(np.int64).max)
    quota = np.minimum(np.maximum(_spread(total, target, far), least), at_hand)
    off = total - int(quota.sum())
    if off > 0:
        return quota + _spread(off, target, at_hand - quota)
    spare = np.where(quota < at_hand, np.maximum(quota - least, 0), 0)
    return quota - _spread(-off, target, spare)


def sample_to_targets(
    rows: DataFrame, row_id: str, category: str, margins: list[str], targets: DataFrame, seed: int = 7
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample, report, margin report). targets: mix_id, category, target_permille, sample_percent, min_records, of bounded
    size; the cells of one mix (its categories by the margins' values) are fitted in one task.

    sample: mix_id, row id, category, margins, weight. report: a row per target with at_hand, wanted_x100000 (the exact
    target), quota, drawn, shares, gap, fit_error and unmet: all rows of the category were drawn and are fewer than the
    target or the minimum. margin report: mix_id, margin, value, target_share, drawn_share, gap.
    """
    with_category = rows.select(row_id, category, *margins).where(F.col(category).isNotNull())
    targets = targets.select("mix_id", category, "target_permille", "sample_percent", "min_records")
    cell_columns = [category, *margins]
    cells = materialize(with_category.groupBy(*cell_columns).agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = targets.join(cells, category, "left").select(*targets.columns, *margins, F.coalesce("n", F.lit(0)).alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        mix = frame.drop_duplicates(category).reset_index(drop=True)
        place = {c: i for i, c in enumerate(mix[category])}
        of = frame[category].map(place).to_numpy()
        n = frame["n"].to_numpy(np.int64)
        at_hand = np.bincount(of, n, len(mix)).astype(np.int64)
        size = int(total * int(mix["sample_percent"].iloc[0]) // 100)
        quota = quotas(mix["target_permille"].to_numpy(float), size, at_hand, mix["min_records"].to_numpy(np.int64))
        fits, drawn = [], float(quota.sum())
        for m in margins if n.sum() else []:
            index = pd.factorize(frame[m], use_na_sentinel=False)[0]
            fits.append((index, np.bincount(index, n) / n.sum() * drawn))
        weight, error = rake(n, [*fits, (of, quota.astype(float))])
        return frame.assign(weight=weight, fit_error=error, at_hand=at_hand[of], quota=quota[of], total=total)

    added = [*(StructField(c, DoubleType()) for c in ("weight", "fit_error")), *(StructField(c, LongType()) for c in ("at_hand", "quota", "total"))]
    schema = StructType([*wanted.schema.fields, *added])
    fitted = materialize(wanted.groupBy("mix_id").applyInPandas(fit, schema), "mix-fitted")

    same = [with_category[c].eqNullSafe(fitted[c]) for c in margins]
    drawn_from = with_category.join(fitted.where("n > 0 AND weight > 0"), [with_category[category] == fitted[category], *same]).select(
        fitted["mix_id"], with_category[row_id], with_category[category], *(with_category[m] for m in margins), "weight", "quota",
        F.xxhash64(F.lit(seed), fitted["mix_id"], with_category[row_id]).alias("__hash"),
    )
    u = (F.shiftrightunsigned("__hash", 11).cast("double") + 0.5) / F.lit(float(2**53))
    # a key below 1 has the probability of the weight, so that full cells are drawn as they are raked
    rate = -F.log1p(-F.least(F.col("weight"), F.lit(1 - 1e-9)))
    keyed = drawn_from.withColumn("__key", -F.ln(u) / rate)
    keyed = materialize(keyed.withColumn("__bucket", F.floor(F.ln("__key") * FINE)).drop("__hash"), "mix-keys")
    group = ["mix_id", category]
    upto = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        keyed.groupBy(*group, "__bucket", "quota").agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__upto", F.sum("__c").over(upto))
        .where("__upto >= quota AND __upto - __c < quota")
        .select(*group, F.col("__bucket").alias("__last"), (F.col("quota") - F.col("__upto") + F.col("__c")).alias("__rest"))
    )
    joined = keyed.join(cut, group)
    columns = ["mix_id", row_id, category, *margins, "weight"]
    within = Window.partitionBy(*group).orderBy("__key", row_id)
    edge = joined.where("__bucket = __last").withColumn("__rank", F.row_number().over(within)).where("__rank <= __rest")
    sample = joined.where("__bucket < __last").select(*columns).unionByName(edge.select(*columns))
    sample = materialize(sample, "mix-sample")
    release(keyed, cells)

    drawn = sample.groupBy(*group).agg(F.count(F.lit(1)).alias("drawn"))
    per_mix = sample.groupBy("mix_id").agg(F.count(F.lit(1)).alias("drawn_in_mix"))
    exact = F.col("target_permille").cast("long") * F.col("sample_percent") * F.col("total")
    short = (F.col("drawn") * 100000 < F.col("wanted_x100000")) | (F.col("drawn") < F.col("min_records"))
    report = (
        fitted.groupBy(*targets.columns).agg(*(F.max(c).alias(c) for c in ("at_hand", "quota", "total", "fit_error")))
        .join(drawn, group, "left").join(per_mix, "mix_id", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("target_share", F.col("target_permille") / 1000)
        .withColumn("drawn_share", F.coalesce(F.col("drawn") / F.col("drawn_in_mix"), F.lit(0.0)))
        .withColumn("gap", F.col("drawn_share") - F.col("target_share"))
        .withColumn("wanted_x100000", exact)
        .withColumn("unmet", (F.col("drawn") == F.col("at_hand")) & short)
    )
    return sample, report, _margin_report(fitted, sample, margins)


def _margin_report(fitted: DataFrame, sample: DataFrame, margins: list[str]) -> DataFrame:
    """Shares of every margin value among the rows of the mix's categories and in the sample."""

    def shares(df: DataFrame, n: Column, out: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")) for m in margins)))
        sums = df.select("mix_id", each.alias("m"), n.alias("n")).groupBy("mix_id", "m.margin", "m.value").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy("mix_id", "margin")  # one row a value
        return sums.select("mix_id", "margin", "value", (F.col("n") / F.sum("n").over(whole)).alias(out))

    if not margins:
        return fitted.select("mix_id", F.lit("").alias("margin"), F.lit("").alias("value"), *(F.lit(0.0).alias(c) for c in ("target_share", "drawn_share", "gap"))).limit(0)
    wanted, got = shares(fitted.where("n > 0"), F.col("n"), "target_share"), shares(sample, F.lit(1), "drawn_share")
    on = (wanted["mix_id"] == got["mix_id"]) & (wanted["margin"] == got["margin"]) & wanted["value"].eqNullSafe(got["value"])
    made = wanted.join(got, on, "left").select(wanted["mix_id"], wanted["margin"], wanted["value"], "target_share", F.coalesce("drawn_share", F.lit(0.0)).alias("drawn_share"))
    return made.withColumn("gap", F.col("drawn_share") - F.col("target_share"))
