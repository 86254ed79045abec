"""The join queries over the driver's tables."""

from __future__ import annotations

from joinlens.workload.spec import Edge, JoinQuery, Predicate

_TABLES = {"r": "region", "n": "nation", "c": "customer", "o": "orders", "l": "lineitem", "p": "part", "s": "supplier"}
_EDGES = (
    Edge("n", "n_regionkey", "r", "r_regionkey"), Edge("c", "c_nationkey", "n", "n_nationkey"), Edge("s", "s_nationkey", "n", "n_nationkey"),
    Edge("o", "o_custkey", "c", "c_custkey"), Edge("l", "l_orderkey", "o", "o_orderkey"), Edge("l", "l_partkey", "p", "p_partkey"),
    Edge("l", "l_suppkey", "s", "s_suppkey"),
)
_PREDS = {
    "o": (Predicate("o_orderstatus", "eq", ("F",)),),
    "c": (Predicate("c_mktsegment", "in", ("BUILDING", "MACHINERY")),),
    "l": (Predicate("l_quantity", "range", (9, 30)),),
    "p": (Predicate("p_size", "range", (10, 40)),),
    "s": (Predicate("s_acctbal", "range", (0.0, None)),),
    "n": (Predicate("n_regionkey", "in", (0, 1, 2)),),
}


def tpch(qid: str, aliases: str, skip: tuple[tuple[str, str], ...] = ()) -> JoinQuery:
    """The query over some of the seven tables, with all foreign keys between them but those in skip."""
    edges = tuple(e for e in _EDGES if e.a in aliases and e.b in aliases and (e.a, e.b) not in skip)
    return JoinQuery(qid, {a: _TABLES[a] for a in aliases}, edges, {a: p for a, p in _PREDS.items() if a in aliases}, template=qid)


G3 = tpch("g3", "col")
G5 = tpch("g5", "ncolp")
G6 = tpch("g6", "ncolps", (("s", "n"),))
G7 = tpch("g7", "rncolps")
#: Two lines of an order: an inequality beside the equality, so no tree.
SELF = JoinQuery(
    "self", {"l1": "lineitem", "l2": "lineitem", "o": "orders"},
    (Edge("l1", "l_orderkey", "o", "o_orderkey"), Edge("l2", "l_orderkey", "o", "o_orderkey"), Edge("l1", "l_linenumber", "l2", "l_linenumber", "!=")),
    {"o": (Predicate("o_orderpriority", "like", ("1%",)),)}, template="self",
)
#: Connected through the hub table alone: the full set is a cross join.
HUB = JoinQuery(
    "hub", {"c": "customer", "n": "nation", "s": "supplier"},
    (Edge("c", "c_nationkey", "n", "n_nationkey"), Edge("s", "s_nationkey", "n", "n_nationkey")), hubs=frozenset({"nation"}), template="hub",
)
#: Titles and two kinds of their texts; cyclic by a redundant condition.
IMDB = JoinQuery(
    "imdb", {"t": "title", "mi1": "movie_info", "mi2": "movie_info", "kt": "kind_type"},
    (Edge("mi1", "movie_id", "t", "id"), Edge("mi2", "movie_id", "t", "id"), Edge("mi1", "movie_id", "mi2", "movie_id"), Edge("t", "kind_id", "kt", "id")),
    {"t": (Predicate("production_year", "range", (1960, 2005)),), "mi1": (Predicate("info_type_id", "eq", (3,)),), "mi2": (Predicate("info_type_id", "in", (5, 8)),)},
    template="imdb",
)
ALL = (G3, G5, G6, G7, SELF, IMDB)
