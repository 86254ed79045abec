"""Cost models of a plan edge, as Column expressions.

An edge joins big = small + other, one side a single table. s is the row count of that single table (small if it is one,
else other), o that of the other side, c3 of the result, ts the unfiltered count of the single table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the models.
NILJ = 0.001
NILJ2 = 2.0
SEQ = 20.0
RATIO = 1.0
MIN_CARD = 5
DIV = 0.001
IDX = 10000.0
PENALTY = 10.0


def _operands() -> tuple[Column, Column, Column, Column]:
    single = ~F.contains(F.col("small"), F.lit(" "))
    s = F.when(single, F.col("c1")).otherwise(F.col("c2"))
    o = F.when(single, F.col("c2")).otherwise(F.col("c1"))
    ts = F.when(single, F.col("t1")).otherwise(F.col("t2"))
    return s, o, F.col("c3"), ts


def _small_is_single() -> Column:
    return ~F.contains(F.col("small"), F.lit(" "))


def _product() -> Column:
    return F.col("c1") * F.col("c2")


def _lookup() -> Column:
    """Rows that the index of the single table yields before its filters."""
    s, _, c3, ts = _operands()
    return c3 * ts / s


def cm1() -> Column:
    s, o, _, _ = _operands()
    return o + NILJ * s


def hash_join() -> Column:
    return DIV * F.col("c1") + DIV * F.col("c2")


def nested_loop() -> Column:
    return _product()


def index1() -> Column:
    _, o, c3, _ = _operands()
    return NILJ2 * o * F.greatest(c3 / o, F.lit(1.0))


def index2() -> Column:
    return NILJ2 * _operands()[1]


def index3() -> Column:
    return cm1() + F.col("c3")


def index4() -> Column:
    return F.least(index1() * RATIO, _product())


def _tiny() -> Column:
    return (F.col("c1") < MIN_CARD) | (F.col("c2") < MIN_CARD)


def index5() -> Column:
    return F.when(_tiny(), _product()).otherwise(index4())


def index6() -> Column:
    return F.when(_tiny(), _product()).otherwise(F.least(NILJ2 * RATIO * F.greatest("c1", "c2"), _product()))


def index7() -> Column:
    return F.least(cm1(), _product())


def index8() -> Column:
    return F.least(index10(), SEQ * _product())


def index8_debug() -> Column:
    scale = F.when((F.col("c1") < 10) | (F.col("c2") < 10), 1.0).otherwise(10000.0)
    return F.least(index9(), scale * _product())


def index9() -> Column:
    return _operands()[1] + _lookup()


def index10() -> Column:
    return F.greatest(_lookup(), _operands()[1])


def index11() -> Column:
    return index10() * _operands()[3] / IDX


def index12() -> Column:
    """The index term of the single table counts only where it is the small side."""
    s, o, _, _ = _operands()
    return F.least(F.when(_small_is_single(), o + NILJ * s).otherwise(o) + _lookup(), _product())


# The aliases of model 13 whose look-up is dear without a partner, these partners, and the clustered aliases.
FACTS = ("ci",)
PARTNERS = ("t", "mc", "mi1", "mi2", "mii1")
CLUSTERED = ("t", "n", "k")


def index13(facts: tuple[str, ...] = FACTS, partners: tuple[str, ...] = PARTNERS, clustered: tuple[str, ...] = CLUSTERED) -> Column:
    """Penalties where a fact alias is looked up without a partner, and where the single table is not a clustered one."""
    single = F.when(_small_is_single(), F.col("small")).otherwise(F.col("other"))
    rest = F.when(_small_is_single(), F.col("other")).otherwise(F.col("small"))
    partnered = F.arrays_overlap(F.split(rest, " "), F.array(*map(F.lit, partners)))
    lonely = F.when(single.isin(*facts) & ~partnered, PENALTY).otherwise(1.0)
    unclustered = F.when(single.isin(*clustered), 1.0).otherwise(PENALTY)
    return F.least(index9() * lonely * unclustered, _product())


def index14() -> Column:
    """The second alternative adds the small side's index term in either case."""
    return F.least(cm1() + _lookup(), NILJ * F.col("c1") + _product())


#: Models by name; nested_loop_index7 is the default.
MODELS: dict[str, Callable[[], Column]] = {
    "cm1": cm1, "cm2": hash_join, "nested_loop_index": index1, "nested_loop_index2": index2, "nested_loop_index3": index3,
    "nested_loop_index4": index4, "nested_loop_index5": index5, "nested_loop_index6": index6, "nested_loop_index7": index7,
    "nested_loop_index8b": index7, "nested_loop_index7b": cm1, "nested_loop_index8": index8, "nested_loop_index8_debug": index8_debug,
    "nested_loop_index9": index9, "nested_loop_index10": index10, "nested_loop_index11": index11, "nested_loop_index12": index12,
    "nested_loop_index13": index13, "nested_loop_index14": index14, "nested_loop": nested_loop, "hash_join": hash_join,
}
DEFAULT = "nested_loop_index7"


def with_cost(edges: DataFrame, model: str = DEFAULT, out: str = "cost") -> DataFrame:
    """edges (of with_cards) with the cost of a model."""
    if model not in MODELS:
        raise ValueError(f"unknown cost model {model}; known: {', '.join(MODELS)}")
    return edges.withColumn(out, MODELS[model]())


def with_both_costs(edges: DataFrame, model: str = DEFAULT) -> DataFrame:
    """(qid, big, small, other, true_cost, est_cost) of edges with c1..c3 and e1..e3."""
    true = with_cost(edges, model, "true_cost").drop("c1", "c2", "c3")
    est = with_cost(true.withColumnsRenamed({"e1": "c1", "e2": "c2", "e3": "c3"}), model, "est_cost")
    return est.select("qid", "big", "small", "other", "true_cost", "est_cost")


def scan_labels(edges: DataFrame) -> DataFrame:
    """scan_small, scan_other: sequential on single tables where the product is cheaper, else an index scan on the looked-up one."""
    single, seq = _small_is_single(), _product() < cm1()
    small = F.when(single, F.when(seq, "Seq Scan").otherwise("Index Scan"))
    other = F.when(seq, "Seq Scan").when(single, "Seq Scan").otherwise("Index Scan")
    return edges.withColumn("scan_small", small).withColumn("scan_other", other)
