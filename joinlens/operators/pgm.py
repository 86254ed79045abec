"""Tree-structured probability models of a table: marginals, pairwise joints, maximum spanning tree, upward messages."""

from __future__ import annotations

from collections import deque
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators.windows import global_rank
from joinlens.session import materialize

#: Terms whose probabilities are below EPSILON / (rows * columns of the joint) do not count.
EPSILON = 1e-6
#: How columns without a value enter the model.
NULL = "-1"


def frequency(df: DataFrame, columns: list[str], at_least: int = 1) -> DataFrame:
    """(columns as text, w): the joint frequency table, from which everything else is built."""
    made = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(c) for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("w"))
    return made.where(F.col("w") >= at_least)


def alphabet(freq: DataFrame, column: str) -> DataFrame:
    """(value, code): codes 0..n-1 in the order of the values."""
    ranked = global_rank(freq.select(F.col(column).alias("value")).distinct(), ["value"], "code")
    return ranked.withColumn("code", F.col("code") - 1)


def marginals(freq: DataFrame, columns: list[str]) -> DataFrame:
    """(col_name, value, p), weighted by the frequencies; each row of the table is exploded once."""
    each = freq.select("w", F.explode(F.array(*(F.struct(F.lit(c).alias("col_name"), F.col(c).alias("value")) for c in columns))).alias("x"))
    counts = each.groupBy("x.col_name", "x.value").agg(F.sum("w").alias("c"))
    total = freq.agg(F.sum("w").alias("__t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("col_name", "value", (F.col("c") / F.col("__t")).alias("p"))


def joints(freq: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, va, vb, p) of every pair of columns, a before b in the list."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb")) for a, b in combinations(columns, 2)]
    each = freq.select("w", F.explode(F.array(*pairs)).alias("x"))
    counts = each.groupBy("x.a", "x.b", "x.va", "x.vb").agg(F.sum("w").alias("c"))
    total = freq.agg(F.sum("w").alias("__t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("a", "b", "va", "vb", (F.col("c") / F.col("__t")).alias("p"))


def mutual_information(joint: DataFrame, marginal: DataFrame) -> DataFrame:
    """(a, b, mi) with natural logarithms."""
    sizes = marginal.groupBy("col_name").agg(F.count(F.lit(1)).alias("n"))
    pa = marginal.select(F.col("col_name").alias("a"), F.col("value").alias("va"), F.col("p").alias("pa"))
    pb = marginal.select(F.col("col_name").alias("b"), F.col("value").alias("vb"), F.col("p").alias("pb"))
    made = joint.join(pa, ["a", "va"]).join(pb, ["b", "vb"])
    made = made.join(sizes.select(F.col("col_name").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("col_name").alias("b"), F.col("n").alias("nb")), "b")
    least = EPSILON / (F.col("na") * F.col("nb"))
    term = F.when((F.col("p") > least) & (F.col("pa") > least) & (F.col("pb") > least), F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).otherwise(0.0)
    return made.groupBy("a", "b").agg(F.sum(term).alias("mi"))


def spanning_tree(mi: list[tuple[str, str, float]], within: set[str] | None = None) -> list[tuple[str, str]]:
    """(parent, child) edges of the maximum spanning tree, rooted at the first end of its strongest edge.

    within keeps only some columns (two at least). One row for each pair of columns, so a few hundred.
    """
    rows = [r for r in mi if within is None or len(within) < 2 or (r[0] in within and r[1] in within)]
    rows.sort(key=lambda r: (-r[2], r[0], r[1]))
    root_of: dict[str, str] = {}

    def find(x: str) -> str:
        while root_of.setdefault(x, x) != x:
            x = root_of[x]
        return x

    near: dict[str, list[str]] = {}
    for a, b, _ in rows:
        if find(a) != find(b):
            root_of[find(a)] = find(b)
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    out, seen, todo = [], {rows[0][0]} if rows else set(), deque([rows[0][0]] if rows else [])
    while todo:
        a = todo.popleft()
        for b in near.get(a, []):
            if b not in seen:
                seen.add(b)
                out.append((a, b))
                todo.append(b)
    return out


def infer(joint: DataFrame, marginal: DataFrame, tree: list[tuple[str, str]], queries: DataFrame, filters: DataFrame) -> DataFrame:
    """(qid, p) of each query: the probability that every filtered column lies in its set of values.

    queries: qid; filters: qid, col_name, value[, weight] (a column without rows is not filtered; values that the model has
    not seen are ignored; weight, 1 if absent, scales a value that a bin covers in part). Messages go up the tree: each edge
    is one join with the child's weights and one aggregate.
    """
    root = tree[0][0]
    filters = filters if "weight" in filters.columns else filters.withColumn("weight", F.lit(1.0))
    incoming: dict[str, DataFrame] = {}

    def weights(column: str) -> DataFrame:
        """(qid, value, w): allowed values times the messages of the column's children."""
        known = marginal.where(F.col("col_name") == column).select("value")
        own = filters.where(F.col("col_name") == column).select("qid", "value", F.col("weight").alias("w"))
        free = queries.join(own.select("qid").distinct(), "qid", "left_anti").crossJoin(known)  # one alphabet a query
        made = own.join(known, "value").select("qid", "value", "w").unionByName(free.select("qid", "value", F.lit(1.0).alias("w")))
        for child in (c for p, c in tree if p == column):
            made = made.join(incoming[child].withColumnRenamed("m", f"__{child}"), ["qid", "value"])
            made = made.select("qid", "value", (F.col("w") * F.col(f"__{child}")).alias("w"))
        return made

    for parent, child in reversed(tree):
        forward = joint.where((F.col("a") == parent) & (F.col("b") == child)).select(F.col("va").alias("pv"), F.col("vb").alias("value"), "p")
        backward = joint.where((F.col("a") == child) & (F.col("b") == parent)).select(F.col("vb").alias("pv"), F.col("va").alias("value"), "p")
        pair = forward.unionByName(backward)
        base = marginal.where(F.col("col_name") == parent).select(F.col("value").alias("pv"), F.col("p").alias("pp"))
        message = weights(child).join(pair, "value").join(base, "pv").groupBy("qid", "pv").agg(F.sum(F.col("w") * F.col("p") / F.col("pp")).alias("m"))
        incoming[child] = message.withColumnRenamed("pv", "value")
    top = weights(root).join(marginal.where(F.col("col_name") == root).select("value", "p"), "value")
    sums = top.groupBy("qid").agg(F.least(F.lit(1.0), F.sum(F.col("w") * F.col("p"))).alias("p"))
    return queries.join(sums, "qid", "left").select("qid", F.coalesce("p", F.lit(0.0)).alias("p"))


def parameter_count(marginal: DataFrame, tree: list[tuple[str, str]]) -> int:
    """Numbers that the model stores: a marginal for each column and a joint for each tree edge."""
    sizes = {r["col_name"]: r["n"] for r in marginal.groupBy("col_name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
    return sum(sizes.values()) + sum(sizes[a] * sizes[b] for a, b in tree)


def low_rank(joint: DataFrame, k: int) -> DataFrame:
    """The joints replaced by their rank-k approximation, one pair of columns a task (alphabets are bounded by the binning)."""

    def shrink(frame):
        table = frame.pivot(index="va", columns="vb", values="p").fillna(0.0)
        u, s, v = np.linalg.svd(table.to_numpy(), full_matrices=False)
        table.loc[:, :] = (u[:, :k] * s[:k]) @ v[:k]
        out = table.reset_index().melt(id_vars="va", var_name="vb", value_name="p")
        out["a"], out["b"] = frame["a"].iloc[0], frame["b"].iloc[0]
        return out[["a", "b", "va", "vb", "p"]]

    return joint.groupBy("a", "b").applyInPandas(shrink, "a string, b string, va string, vb string, p double")


def corrections(joint: DataFrame, marginal: DataFrame, k: int) -> DataFrame:
    """(a, b, va, vb, c) of every pair of columns: the sum over the k largest singular values of (p - pa pb) / sqrt(pa pb) of
    value times both vectors, each scaled by 1 / sqrt of its marginal; p = pa pb (1 + c) where all are kept."""

    def one(frame):
        table = frame.pivot(index="va", columns="vb", values="p").fillna(0.0)
        pa = frame.drop_duplicates("va").set_index("va")["pa"].loc[table.index].to_numpy()
        pb = frame.drop_duplicates("vb").set_index("vb")["pb"].loc[table.columns].to_numpy()
        alone = np.outer(pa, pb)
        u, s, v = np.linalg.svd((table.to_numpy() - alone) / np.sqrt(alone), full_matrices=False)
        table.loc[:, :] = ((u[:, :k] * s[:k]) @ v[:k]) / np.sqrt(alone)
        out = table.reset_index().melt(id_vars="va", var_name="vb", value_name="c")
        out["a"], out["b"] = frame["a"].iloc[0], frame["b"].iloc[0]
        return out[["a", "b", "va", "vb", "c"]]

    pa = marginal.select(F.col("col_name").alias("a"), F.col("value").alias("va"), F.col("p").alias("pa"))
    pb = marginal.select(F.col("col_name").alias("b"), F.col("value").alias("vb"), F.col("p").alias("pb"))
    return joint.join(pa, ["a", "va"]).join(pb, ["b", "vb"]).groupBy("a", "b").applyInPandas(one, "a string, b string, va string, vb string, c double")


def pairwise(correction: DataFrame, marginal: DataFrame, tree: list[tuple[str, str]], points: DataFrame) -> DataFrame:
    """(qid, p) of points (qid, col_name, value): independence, times one plus the corrections of the edges within the point.
    A value that the model has not seen has probability 0."""
    spark = points.sparkSession
    known = points.join(marginal, ["col_name", "value"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    alone = known.groupBy("qid").agg(F.product("p").alias("alone"))
    edges = spark.createDataFrame([(min(e), max(e)) for e in tree], "x string, y string")  # a tree of columns
    swapped = F.col("a") > F.col("b")
    sided = correction.select(
        F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(swapped, F.col("vb")).otherwise(F.col("va")).alias("vx"),
        F.when(swapped, F.col("va")).otherwise(F.col("vb")).alias("vy"), "c",
    )
    left, right = (points.select("qid", F.col("col_name").alias(c), F.col("value").alias(f"v{c}")) for c in "xy")
    both = left.join(edges, "x").join(right, ["qid", "y"]).join(sided, ["x", "y", "vx", "vy"])
    sums = both.groupBy("qid").agg(F.sum("c").alias("c"))
    return alone.join(sums, "qid", "left").select("qid", (F.col("alone") * (1 + F.coalesce("c", F.lit(0.0)))).alias("p"))


def fit(df: DataFrame, columns: list[str], at_least: int = 1) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """(joints, marginals, tree) of a table."""
    freq = materialize(frequency(df, columns, at_least), "pgm-frequency")
    marginal, joint = materialize(marginals(freq, columns), "pgm-marginals"), materialize(joints(freq, columns), "pgm-joints")
    mi = [tuple(r) for r in mutual_information(joint, marginal).collect()]  # one row a pair of columns
    return joint, marginal, spanning_tree(mi)
