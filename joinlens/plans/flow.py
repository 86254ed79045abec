"""Flow loss: the plan graph of a query as an electric network, solved one query a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.plans.edges import SOURCE


def with_source(edges: DataFrame, cost: str) -> DataFrame:
    """(qid, big, small, costs) plus the edges from single tables to the source at cost 1."""
    columns = ["qid", "big", "small", *cost.split(",")]
    single = edges.where(F.size(F.split("big", " ")) == 2).select("qid", F.explode(F.array("small", "other")).alias("big")).distinct()
    source = single.select("qid", "big", F.lit(SOURCE).alias("small"), *(F.lit(1.0).alias(c) for c in cost.split(",")))
    return edges.select(*columns).unionByName(source)


def solve(big: np.ndarray, small: np.ndarray, cost: np.ndarray, power: float = 2.0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(flow of each edge, potentials) of one unit from the largest node to the grounded source, conductance 1 / cost.

    power other than 2 reweights conductances by flow^(2 - power) for some rounds.
    """
    names = sorted({*big, *small} - {SOURCE})
    at = {n: i for i, n in enumerate(names)}
    n = len(names)
    heads, tails = np.array([at[b] for b in big]), np.array([at.get(s, n) for s in small])
    full = at[max(names, key=lambda x: (x.count(" "), x))]
    unit = np.zeros(n)
    unit[full] = 1.0
    g = 1.0 / cost
    for _ in range(max(1, rounds)):
        lap = np.zeros((n + 1, n + 1))
        np.add.at(lap, (heads, heads), g)
        np.add.at(lap, (tails, tails), g)
        np.add.at(lap, (heads, tails), -g)
        np.add.at(lap, (tails, heads), -g)
        v = np.append(np.linalg.solve(lap[:n, :n], unit), 0.0)
        flow = g * (v[heads] - v[tails])
        if power == 2.0:
            break
        g = 1.0 / (cost * np.maximum(np.abs(flow), 1e-9) ** (power - 2.0))
    return flow, v


def flows(edges: DataFrame, est_cost: str, true_cost: str, power: float = 2.0, rounds: int = 1) -> DataFrame:
    """(qid, big, small, flow, loss_part, on_path): loss_part is true cost times squared flow; on_path marks the path that
    follows the largest flow from the whole query down. A query's graph (a few thousand nodes at most) is one task's work."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["big", "small"]).reset_index(drop=True)
        flow, _ = solve(frame["big"].to_numpy(), frame["small"].to_numpy(), frame[est_cost].to_numpy(float), power, rounds)
        on_path = np.zeros(len(frame), bool)
        node = max(frame["big"], key=lambda x: (x.count(" "), x))
        while node != SOURCE:
            here = np.flatnonzero(frame["big"].to_numpy() == node)
            pick = here[np.argmax(flow[here])]
            on_path[pick] = True
            node = frame["small"].iloc[pick]
        part = frame[true_cost].to_numpy(float) * flow**2
        return pd.DataFrame({"qid": frame["qid"].astype(str), "big": frame["big"], "small": frame["small"], "flow": flow, "loss_part": part, "on_path": on_path})

    both = f"{est_cost},{true_cost}" if est_cost != true_cost else est_cost
    network = with_source(edges, both)
    return network.groupBy("qid").applyInPandas(one, "qid string, big string, small string, flow double, loss_part double, on_path boolean")


def flow_loss(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.sum("loss_part").alias("flow_loss"))


def gradients(edges: DataFrame, est_cost: str, true_cost: str) -> DataFrame:
    """(qid, big, small, gradient) of the flow loss by the estimated cost of each edge, by the adjoint of the linear system."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        big, small = frame["big"].to_numpy(), frame["small"].to_numpy()
        cost, true = frame[est_cost].to_numpy(float), frame[true_cost].to_numpy(float)
        names = sorted({*big, *small} - {SOURCE})
        at = {n: i for i, n in enumerate(names)}
        n, g = len(names), 1.0 / cost
        heads, tails = np.array([at[b] for b in big]), np.array([at.get(s, n) for s in small])
        flow, v = solve(big, small, cost)
        lap = np.zeros((n + 1, n + 1))
        for i, j, x in ((heads, heads, g), (tails, tails, g), (heads, tails, -g), (tails, heads, -g)):
            np.add.at(lap, (i, j), x)
        pull = np.zeros(n + 1)
        np.add.at(pull, heads, 2 * true * flow * g)
        np.add.at(pull, tails, -2 * true * flow * g)
        adjoint = np.append(np.linalg.solve(lap[:n, :n], pull[:n]), 0.0)
        by_g = 2 * true * flow * (v[heads] - v[tails]) - (adjoint[heads] - adjoint[tails]) * (v[heads] - v[tails])
        return pd.DataFrame({"qid": frame["qid"].astype(str), "big": big, "small": small, "gradient": -by_g * g**2})

    network = with_source(edges, f"{est_cost},{true_cost}")
    return network.groupBy("qid").applyInPandas(one, "qid string, big string, small string, gradient double")


def card_gradients(edges: DataFrame, by_cost: DataFrame, cost_of, step: float = 1e-4) -> DataFrame:
    """(qid, subset, gradient) of the flow loss by the logarithm of each sub-join's count.

    edges: of edges.with_cards; by_cost: of gradients; cost_of: a cost model. Slopes of the cost by its counts are central
    differences of the model's expression; a sub-join's gradient is their sum over the edges in which it stands.
    """

    def moved(c: str, by: float) -> DataFrame:
        return edges.withColumn(c, F.col(c) * float(np.exp(by))).select("qid", "big", "small", cost_of().alias("x"))

    parts = None
    for c, name in (("c1", "small"), ("c2", "other"), ("c3", "big")):
        up, down = moved(c, step).withColumnRenamed("x", "up"), moved(c, -step).withColumnRenamed("x", "down")
        slope = edges.select("qid", "big", "small", F.col(name).alias("subset")).join(up, ["qid", "big", "small"]).join(down, ["qid", "big", "small"])
        slope = slope.select("qid", "big", "small", "subset", ((F.col("up") - F.col("down")) / (2 * step)).alias("slope"))
        parts = slope if parts is None else parts.unionByName(slope)
    met = parts.join(by_cost, ["qid", "big", "small"])
    return met.groupBy("qid", "subset").agg(F.sum(F.col("slope") * F.col("gradient")).alias("gradient"))


def node_importance(found: DataFrame) -> DataFrame:
    """(qid, subset, importance): flow into each sub-join, 1 for the whole query."""
    into = found.where(F.col("small") != SOURCE).groupBy("qid", F.col("small").alias("subset")).agg(F.sum("flow").alias("importance"))
    size = F.length(F.regexp_replace("big", "[^ ]", ""))
    top = found.groupBy("qid").agg(F.max_by("big", F.struct(size, F.col("big"))).alias("subset")).withColumn("importance", F.lit(1.0))
    return into.unionByName(top)


def weight_schemes(found: DataFrame, paths: DataFrame, tolerances: DataFrame | None = None) -> DataFrame:
    """(qid, subset, flow1..flow4, paths[, tolerance]) as sampling weights: flow; flow over level; flow over size; flow times
    the number of sub-joins of its level; share of paths; 1 / log2 of the tolerance."""
    imp = node_importance(found).withColumn("n", F.size(F.split("subset", " ")))
    level = imp.groupBy("qid", "n").agg(F.sum("importance").alias("sum_level"), F.count(F.lit(1)).alias("c"))
    made = imp.join(level, ["qid", "n"]).join(paths, ["qid", "subset"], "left")
    made = made.select(
        "qid", "subset", F.col("importance").alias("flow1"), (F.col("importance") / F.col("sum_level")).alias("flow2"),
        (F.col("importance") / F.col("n")).alias("flow3"), (F.col("importance") * F.col("c")).alias("flow4"), "n_paths",
    )
    return made.join(tolerances.withColumn("by_tolerance", 1 / F.log2("tolerance")), ["qid", "subset"], "left") if tolerances is not None else made
