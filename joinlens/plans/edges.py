"""Plan edges: from each sub-join to the one without one of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.workload.spec import JoinQuery

SOURCE = "s0"


def subset_table(spark: SparkSession, queries: list[JoinQuery]) -> DataFrame:
    """(qid, subset, n_tables, is_full) of the connected subsets of small queries, enumerated on the driver."""
    rows = [(q.qid, " ".join(s), len(s), len(s) == len(q.tables)) for q in queries for s in q.subsets()]
    return spark.createDataFrame(rows, "qid string, subset string, n_tables int, is_full boolean")


def connected_subsets(edges: DataFrame, nodes: DataFrame, max_tables: int = 17) -> DataFrame:
    """(qid, subset, n_tables) of many queries at once: level by level along edges.

    edges: qid, a, b (either direction); nodes: qid, alias. A level joins the one before with the edges of its query.
    """
    both = edges.select("qid", "a", "b").unionByName(edges.select("qid", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    step = both.groupBy("qid", "a").agg(F.collect_set("b").alias("next"))  # at most the aliases of one query
    level = nodes.select("qid", F.array("alias").alias("s"))
    out = level
    for _ in range(max_tables - 1):
        reach = level.select("qid", "s", F.explode("s").alias("a")).join(step, ["qid", "a"])
        grown = reach.select("qid", "s", F.explode(F.array_except("next", "s")).alias("b"))
        level = grown.select("qid", F.array_sort(F.array_append("s", F.col("b"))).alias("s")).distinct()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("qid", F.array_join("s", " ").alias("subset"), F.size("s").alias("n_tables"))


def drop_one_edges(subsets: DataFrame) -> DataFrame:
    """(qid, big, small, other) for every connected subset of two or more and each alias whose removal leaves one."""
    big = subsets.where("n_tables > 1").select("qid", F.col("subset").alias("big"), F.explode(F.split("subset", " ")).alias("other"))
    rest = F.array_join(F.array_except(F.split("big", " "), F.array("other")), " ")
    smalls = subsets.select("qid", F.col("subset").alias("small"))
    return big.select("qid", "big", rest.alias("small"), "other").join(smalls, ["qid", "small"]).select("qid", "big", "small", "other")


def source_edges(subsets: DataFrame) -> DataFrame:
    """Single tables lead to the source at cost 1."""
    single = subsets.where("n_tables = 1")
    return single.select("qid", F.col("subset").alias("big"), F.lit(SOURCE).alias("small"), F.lit("").alias("other"), F.lit(1.0).alias("cost"))


def with_cards(edges: DataFrame, cards: DataFrame, card: str = "value", total: str | None = None, est: str | None = None) -> DataFrame:
    """Edges with c1 (small), c2 (other), c3 (big) and t1, t2 (unfiltered small, other), floored at 1, as doubles; with est
    also e1, e2, e3, the same of a second count.

    cards: qid, subset, card, total and est columns; one row a subset. Three joins on (qid, subset).
    """
    total = total or card

    def side(name: str, at: str) -> DataFrame:
        kinds = {"c": card, **({} if at == "3" else {"t": total}), **({"e": est} if est else {})}
        return cards.select("qid", F.col("subset").alias(name), *(F.greatest(F.col(c).cast("double"), F.lit(1.0)).alias(f"{k}{at}") for k, c in kinds.items()))

    made = edges.join(side("small", "1"), ["qid", "small"]).join(side("other", "2"), ["qid", "other"]).join(side("big", "3"), ["qid", "big"])
    return made.select("qid", "big", "small", "other", "c1", "c2", "c3", "t1", "t2", *(["e1", "e2", "e3"] if est else []))
