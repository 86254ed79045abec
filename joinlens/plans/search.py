"""Plan search over the graph of sub-joins, for all queries of a workload at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinlens.plans import local
from joinlens.plans.local import per_query


def left_deep(edges: DataFrame, cost: str, carry: dict[str, str] | None = None, full: bool = False) -> DataFrame:
    """(qid, subset, best, small, path, carried...) of every subset: its cheapest left-deep plan; full: of whole queries only.

    best(S) is the least cost(edge) + best(small) over the edges of S, ties by the name of small. carry sums further cost
    columns along the chosen edges. Single tables cost nothing (the constant source edge is left out, as costs are reported
    without it). path is the join order from the first table on.
    """
    carry = carry or {}

    def make(big, small, other, costs, *carried):
        found = local.cheapest(big, small, other, costs, list(carried))
        return [(s, *found[s][:3], *found[s][3]) for s in (local.largest(found) if full else found)]

    schema = "subset string, best double, small string, path string" + "".join(f", `{c}` double" for c in carry)
    doubles = edges.withColumns({c: F.col(c).cast("double") for c in {cost, *carry.values()}})
    return per_query(doubles, ["big", "small", "other", cost, *carry.values()], make, schema)


def plan_loss(edges: DataFrame, true_cost: str, est_cost: str) -> DataFrame:
    """(qid, est_plan_cost, best_cost, loss, ratio, est_path, best_path): the plan chosen by estimated costs under true costs."""

    def make(big, small, other, true, est):
        chosen, best = local.cheapest(big, small, other, est, [true]), local.cheapest(big, small, other, true, [])
        return [(chosen[s][3][0], best[s][0], max(chosen[s][3][0] - best[s][0], 0.0), chosen[s][3][0] / best[s][0] if best[s][0] else None, chosen[s][2], best[s][2]) for s in local.largest(best)]

    schema = "est_plan_cost double, best_cost double, loss double, ratio double, est_path string, best_path string"
    doubles = edges.withColumns({c: F.col(c).cast("double") for c in (true_cost, est_cost)})
    return per_query(doubles, ["big", "small", "other", true_cost, est_cost], make, schema)


def subquery_priorities(edges: DataFrame, true_cost: str, est_cost: str, scale: float = 1e6) -> DataFrame:
    """(qid, subset, priority): every sub-join has the plan loss of its query, and more if it can be blamed.

    From the whole query down the estimated plan: while the sub-plan's own loss is more than a third of the loss at hand, the
    blame goes down to it; once it is less, every sub-join within the tables at hand gets the loss at hand on top. Sub-plans of
    fewer than three tables have no loss. Priorities are divided by scale.
    """

    def make(big, small, other, true, est):
        chosen, best = local.cheapest(big, small, other, est, [true]), local.cheapest(big, small, other, true, [])

        def loss(s: str) -> float:
            return max(chosen[s][3][0] - best[s][0], 0.0) if local.size(s) >= 3 else 0.0

        out = []
        for top in local.largest(best):
            whole = max(chosen[top][3][0] - best[top][0], 0.0)
            at, error, blamed = top, whole, None
            while chosen[at][1] is not None and (below := loss(chosen[at][1])) != error / 3:
                if below < error / 3:
                    blamed = set(at.split(" "))
                    break
                at, error = chosen[at][1], below
            inside = (s for s in best if set(s.split(" ")) <= set(top.split(" ")))
            out += [(s, (whole + (error if blamed and set(s.split(" ")) <= blamed else 0.0)) / scale) for s in inside]
        return out

    doubles = edges.withColumns({c: F.col(c).cast("double") for c in (true_cost, est_cost)})
    return per_query(doubles, ["big", "small", "other", true_cost, est_cost], make, "subset string, priority double")


def query_weights(losses: DataFrame, subsets: DataFrame, by: str = "loss", per_node: bool = False, other: DataFrame | None = None) -> DataFrame:
    """(qid, subset, weight): the loss of the query (0 at least, in millions) or its cost ratio for each of its sub-joins;
    per_node shares it among them, other (qid, subset, w) multiplies it by a weight of their own."""
    value = F.greatest(F.col("loss"), F.lit(0.0)) / 1e6 if by == "loss" else F.col("ratio")
    weighted = losses.select("qid", value.alias("weight"))
    if per_node:
        counts = subsets.groupBy("qid").agg(F.count(F.lit(1)).alias("__n"))
        weighted = weighted.join(counts, "qid").select("qid", (F.col("weight") / F.col("__n")).alias("weight"))
    made = subsets.join(weighted, "qid")
    if other is not None:
        made = made.join(other, ["qid", "subset"]).withColumn("weight", F.col("weight") * F.col("w")).drop("w")
    return made.select("qid", "subset", "weight")


def path_flags(edges: DataFrame, cost: str) -> DataFrame:
    """(qid, subset) of the sub-joins on the cheapest plan: the prefixes of its join order."""
    path = left_deep(edges, cost, full=True).select("qid", F.split("path", " ").alias("p"))
    prefix = F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.array_sort(F.slice("p", 1, n)), " "))
    return path.select("qid", F.explode(prefix).alias("subset"))


def leading_hint(path: Column) -> Column:
    """Nested brackets of a left-deep order: ((a b) c)."""
    parts = F.split(path, " ")
    rest = F.slice(parts, 2, F.size(parts))
    return F.aggregate(rest, F.element_at(parts, 1), lambda acc, t: F.concat(F.lit("("), acc, F.lit(" "), t, F.lit(")")))


def simple_paths(edges: DataFrame) -> DataFrame:
    """(qid, subset, n_paths): number of paths from the whole query down to each sub-join."""

    def make(big, small):
        top = max(map(local.size, big), default=0)
        n = {b: 1.0 for b in big if local.size(b) == top}
        for at in sorted(range(len(big)), key=lambda i: -local.size(big[i])):
            if big[at] in n:
                n[small[at]] = n.get(small[at], 0.0) + n[big[at]]
        return list(n.items())

    return per_query(edges, ["big", "small"], make, "subset string, n_paths double")


def bushy(splits: DataFrame, cost: str, carry: str | None = None, full: bool = False) -> DataFrame:
    """(qid, subset, best, tree[, carried]) with any split of a subset: splits qid, big, left, right and the cost columns.

    carry sums a second cost column along the chosen tree.
    """

    def make(big, left, right, costs, other):
        found = local.cheapest_tree(big, left, right, costs, other)
        return [(s, *found[s]) for s in (local.largest(found) if full else found)]

    made = per_query(splits.withColumn("__carry", F.col(carry) if carry else F.lit(0.0)), ["big", "left", "right", cost, "__carry"], make, "subset string, best double, tree string, carried double")
    return made if carry else made.drop("carried")


def join_loss(splits: DataFrame, true_cost: str, est_cost: str) -> DataFrame:
    """(qid, est, opt, loss, ratio): cost, under true counts, of the bushy plan chosen by estimates; opt at most est."""

    def make(big, left, right, true, est):
        chosen, best = local.cheapest_tree(big, left, right, est, true), local.cheapest_tree(big, left, right, true, true)
        pairs = [(max(chosen[s][2], best[s][0]), best[s][0]) for s in local.largest(best)]
        return [(est, opt, est - opt, est / opt if opt else None) for est, opt in pairs]

    return per_query(splits, ["big", "left", "right", true_cost, est_cost], make, "est double, opt double, loss double, ratio double")


def bushy_splits(subsets: DataFrame) -> DataFrame:
    """(qid, big, left, right): every split of a connected subset into two connected ones, the lexically smaller left."""
    s = subsets.select("qid", "subset", F.split("subset", " ").alias("a"))
    big, left = s.select("qid", F.col("subset").alias("big"), F.col("a").alias("all")), s.select("qid", F.col("subset").alias("left"), F.col("a").alias("la"))
    inside = big.join(left, "qid").where((F.size("la") < F.size("all")) & (F.size(F.array_except("la", "all")) == 0))
    made = inside.select("qid", "big", "left", F.array_join(F.array_except("all", "la"), " ").alias("right")).where("left < right")
    return made.join(subsets.select("qid", F.col("subset").alias("right")), ["qid", "right"]).select("qid", "big", "left", "right")


def perturbed(edges: DataFrame, subset_column: str, multipliers: list[float]) -> DataFrame:
    """Edges once for each multiplier, with the counts of one subset scaled by it; qid names the variant."""
    made = edges.withColumn("m", F.explode(F.array(*map(F.lit, multipliers))))

    def scaled(card: str, name: str) -> Column:
        return F.greatest(F.when(F.col(name) == F.col(subset_column), F.col(card) * F.col("m")).otherwise(F.col(card)), F.lit(1.0))

    made = made.withColumns({"c1": scaled("c1", "small"), "c2": scaled("c2", "other"), "c3": scaled("c3", "big")})
    return made.withColumn("qid", F.concat_ws("|", "qid", subset_column, F.col("m").cast("string")))


def tolerance(edges: DataFrame, cost_of, subsets: DataFrame, decades: int = 4) -> DataFrame:
    """(qid, subset, tolerance): the smallest power of ten by which a count can be divided or multiplied so that the
    cheapest plan changes; 10^(decades + 1) where it never does."""
    base = left_deep(edges.withColumn("__cost", cost_of()), "__cost", full=True).select("qid", F.col("path").alias("__path"))
    factors = [10.0**j for j in range(1, decades + 1)] + [10.0**-j for j in range(1, decades + 1)]
    targets = subsets.select(F.col("qid"), F.col("subset").alias("target"))
    wide = edges.join(targets, "qid").withColumn("__q", F.col("qid"))
    varied = perturbed(wide, "target", factors)
    plans = left_deep(varied.withColumn("__cost", cost_of()), "__cost", full=True)
    names = F.split("qid", r"\|")
    seen = plans.select(F.element_at(names, 1).alias("qid"), F.element_at(names, 2).alias("subset"), F.element_at(names, 3).cast("double").alias("m"), "path")
    changed = seen.join(base, "qid").where("path <> __path").groupBy("qid", "subset").agg(F.min(F.greatest(F.col("m"), 1 / F.col("m"))).alias("t"))
    return subsets.select("qid", "subset").join(changed, ["qid", "subset"], "left").select("qid", "subset", F.round(F.coalesce("t", F.lit(10.0 ** (decades + 1)))).cast("long").alias("tolerance"))


def recent_priority(df: DataFrame, key: list[str], epoch: str, value: str, last: int = 5) -> DataFrame:
    """Sum of the last epochs' priorities of each key, scaled to add up to 1 within an epoch."""
    upto = Window.partitionBy(*key).orderBy(epoch).rowsBetween(1 - last, 0)
    summed = df.withColumn("__s", F.sum(value).over(upto))
    totals = summed.groupBy(epoch).agg(F.sum("__s").alias("__t"))
    return summed.join(totals, epoch).withColumn("weight", F.col("__s") / F.col("__t")).drop("__s", "__t")


def sampling_weights(df: DataFrame, value: str, alpha: float, by: list[str]) -> DataFrame:
    """value^alpha, scaled to add up to 1 within each group of by."""
    powered = df.withColumn("__p", F.pow(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(alpha)))
    totals = powered.groupBy(*by).agg(F.sum("__p").alias("__t"))
    return powered.join(totals, by).withColumn("weight", F.col("__p") / F.col("__t")).drop("__p", "__t")
