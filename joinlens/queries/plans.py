"""Sub-plan counts, cost models and plan search over the driver's tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators import cards, stats
from joinlens.plans import costs, edges, search
from joinlens.queries.base import Registry, Tables
from joinlens.session import materialize
from joinlens.workload import catalog as C
from joinlens.workload.spec import JoinQuery, key

R = Registry()
add = R.add

# ---- SQL of the same results


def counts_sql(q: JoinQuery, filters: bool = True) -> str:
    return " UNION ALL ".join(f"SELECT '{q.qid}' AS qid, '{key(s)}' AS subset, {len(s)} AS n_tables, ({q.count_sql(s, filters)}) AS value" for s in q.subsets())


def enumerated_sql(q: JoinQuery, prefix: str = "") -> str:
    """CTEs (for WITH RECURSIVE) sub: connected subsets, grown along the joins from single tables; e: big, small, other."""
    links = ", ".join(f"('{x}', '{y}')" for edge in q.edges for x, y in ((edge.a, edge.b), (edge.b, edge.a)))
    nodes = ", ".join(f"(['{a}'])" for a in sorted(q.tables))
    return (
        f"{prefix}j(a, b) AS (VALUES {links}), {prefix}sub(s) AS (SELECT * FROM (VALUES {nodes}) AS x(s) UNION SELECT list_sort(list_append(s, b)) FROM {prefix}sub JOIN {prefix}j ON list_contains(s, a) AND NOT list_contains(s, b)),"
        f" {prefix}e AS (SELECT array_to_string(s, ' ') AS big, array_to_string(list_filter(s, lambda v: v <> o), ' ') AS small, o AS other FROM (SELECT s, unnest(s) AS o FROM {prefix}sub WHERE len(s) > 1)"
        f" WHERE list_filter(s, lambda v: v <> o) IN (SELECT s FROM {prefix}sub))"
    )


def edges_sql(q: JoinQuery) -> str:
    """CTEs a, t, g: counts, unfiltered counts and edges with c1, c2, c3, t1, t2 and s, o, ts."""
    return f"""WITH RECURSIVE {enumerated_sql(q)}, a AS ({counts_sql(q)}), t AS ({counts_sql(q, False)}),
g0 AS (SELECT e.*, greatest(x.value, 1)::DOUBLE AS c1, greatest(y.value, 1)::DOUBLE AS c2, greatest(z.value, 1)::DOUBLE AS c3,
       greatest(tx.value, 1)::DOUBLE AS t1, greatest(ty.value, 1)::DOUBLE AS t2
       FROM e JOIN a AS x ON x.subset = small JOIN a AS y ON y.subset = other JOIN a AS z ON z.subset = big
       JOIN t AS tx ON tx.subset = small JOIN t AS ty ON ty.subset = other),
g AS (SELECT *, CASE WHEN small NOT LIKE '% %' THEN c1 ELSE c2 END AS s, CASE WHEN small NOT LIKE '% %' THEN c2 ELSE c1 END AS o,
      CASE WHEN small NOT LIKE '% %' THEN t1 ELSE t2 END AS ts FROM g0)"""


_RULES = {
    "cm1": "o + 0.001 * s",
    "cm2": "0.001 * c1 + 0.001 * c2",
    "nested_loop_index": "2 * o * greatest(c3 / o, 1)",
    "nested_loop_index2": "2 * o",
    "nested_loop_index3": "o + 0.001 * s + c3",
    "nested_loop_index4": "least(2 * o * greatest(c3 / o, 1), c1 * c2)",
    "nested_loop_index5": "CASE WHEN c1 < 5 OR c2 < 5 THEN c1 * c2 ELSE least(2 * o * greatest(c3 / o, 1), c1 * c2) END",
    "nested_loop_index6": "CASE WHEN c1 < 5 OR c2 < 5 THEN c1 * c2 ELSE least(2 * greatest(c1, c2), c1 * c2) END",
    "nested_loop_index7": "least(o + 0.001 * s, c1 * c2)",
    "nested_loop_index8b": "least(o + 0.001 * s, c1 * c2)",
    "nested_loop_index7b": "o + 0.001 * s",
    "nested_loop_index8": "least(greatest(c3 * ts / s, o), 20 * c1 * c2)",
    "nested_loop_index8_debug": "least(o + c3 * ts / s, CASE WHEN c1 < 10 OR c2 < 10 THEN 1 ELSE 10000 END * c1 * c2)",
    "nested_loop_index9": "o + c3 * ts / s",
    "nested_loop_index10": "greatest(c3 * ts / s, o)",
    "nested_loop_index11": "greatest(c3 * ts / s, o) * ts / 10000",
    "nested_loop_index12": "least(o + CASE WHEN small NOT LIKE '% %' THEN 0.001 * s ELSE 0 END + c3 * ts / s, c1 * c2)",
    "nested_loop_index13": "least((o + c3 * ts / s) * CASE WHEN CASE WHEN small NOT LIKE '% %' THEN small ELSE other END IN ('t', 'n', 'k') THEN 1 ELSE 10 END, c1 * c2)",
    "nested_loop_index14": "least(o + 0.001 * s + c3 * ts / s, 0.001 * c1 + c1 * c2)",
    "nested_loop": "c1 * c2",
    "hash_join": "0.001 * c1 + 0.001 * c2",
}


def dp_sql(q: JoinQuery, choose: str, carry: str | None = None) -> str:
    """CTEs b1..bn of the level search over g; carry is summed along the choice."""
    out = ["b1 AS (SELECT DISTINCT small AS subset, 0::DOUBLE AS best, small AS path, 0::DOUBLE AS carried FROM g WHERE small NOT LIKE '% %')"]
    for n in range(2, len(q.tables) + 1):
        out.append(
            f"b{n} AS (SELECT big AS subset, best, path, carried FROM (SELECT g.big, {choose} + b.best AS best, b.path || ' ' || g.other AS path,"
            f" {carry or '0'} + b.carried AS carried, row_number() OVER (PARTITION BY g.big ORDER BY {choose} + b.best, g.small) AS r"
            f" FROM g JOIN b{n - 1} AS b ON g.small = b.subset WHERE len(string_split(g.big, ' ')) = {n}) WHERE r = 1)"
        )
    return ", ".join(out)


def dp_keyed_sql(source: str, name: str, keys: str, choose: str, carry: str, levels: int) -> str:
    """CTEs <name>1..<name>n of the level search within each key of a table of edges, and <name> with all levels."""
    on = " AND ".join(f"g.{k} = b.{k}" for k in keys.split(", "))
    gk, bk = ", ".join(f"g.{k}" for k in keys.split(", ")), keys
    out = [f"{name}1 AS (SELECT DISTINCT {bk}, unnest([small, other]) AS subset, 0::DOUBLE AS best, '' AS path, 0::DOUBLE AS carried FROM {source} WHERE len(string_split(big, ' ')) = 2)"]
    for n in range(2, levels + 1):
        path = "CASE WHEN b.path = '' THEN g.small ELSE b.path END || ' ' || g.other"
        out.append(
            f"{name}{n} AS (SELECT {bk}, big AS subset, best, path, carried FROM (SELECT {gk}, g.big, {choose} + b.best AS best, {path} AS path, {carry} + b.carried AS carried,"
            f" row_number() OVER (PARTITION BY {gk}, g.big ORDER BY {choose} + b.best, g.small) AS r"
            f" FROM {source} AS g JOIN {name}{n - 1} AS b ON {on} AND g.small = b.subset WHERE len(string_split(g.big, ' ')) = {n}) WHERE r = 1)"
        )
    return ", ".join(out) + f", {name} AS (" + " UNION ALL ".join(f"SELECT *, {n} AS n FROM {name}{n}" for n in range(1, levels + 1)) + ")"


# ---- sub-plans


def counted(t: Tables, q: JoinQuery, filters: bool = True, shared: bool = True) -> DataFrame:
    return cards.sub_plan_counts(t.spark, t, q, filters, shared)


def actual_and_total(t: Tables, q: JoinQuery) -> DataFrame:
    return cards.actual_and_total(t.spark, t, q).select("subset", "n_tables", "actual", "total")


def _actual_total_sql(q: JoinQuery) -> str:
    return f"SELECT a.subset, a.n_tables, a.value AS actual, t.value AS total FROM ({counts_sql(q)}) AS a JOIN ({counts_sql(q, False)}) AS t USING (subset)"


add(_actual_total_sql(C.G3), "subplan_actual_total_g3")(lambda t: actual_and_total(t, C.G3))
add(counts_sql(C.G3), "subplan_actual_g3")(lambda t: counted(t, C.G3, shared=False))
add(counts_sql(C.G5), "subplan_actual_g5")(lambda t: counted(t, C.G5, shared=False))
add(counts_sql(C.G5), "subplan_shared_count")(lambda t: counted(t, C.G5))
add(counts_sql(C.G5, False), "subplan_total_g5")(lambda t: counted(t, C.G5, False))
add(counts_sql(C.G6), "subplan_shared_g6")(lambda t: counted(t, C.G6))
add(counts_sql(C.G7), "subplan_actual_g7")(lambda t: counted(t, C.G7))
add(counts_sql(C.SELF), "subplan_self_join")(lambda t: counted(t, C.SELF))
add(counts_sql(C.IMDB), "subplan_imdb")(lambda t: counted(t, C.IMDB))


@add(f"SELECT qid, subset, n_tables, value, 'ok' AS status FROM ({counts_sql(C.HUB)}) UNION ALL SELECT 'hub', 'c n s', 3, 150001000000, 'cross_join'")
def cross_join_status(t: Tables) -> DataFrame:
    found = cards.with_status(counted(t, C.HUB), C.HUB)
    return cards.with_sentinels(found).join(found.select("subset", "status"), "subset").select("qid", "subset", "n_tables", "value", "status")


@add("WITH RECURSIVE " + ", ".join(enumerated_sql(q, f"{q.qid}_") for q in C.ALL) + " " + " UNION ALL ".join(
    f"SELECT '{q.qid}' AS qid, array_to_string(s, ' ') AS subset, len(s)::INT AS n_tables FROM {q.qid}_sub" for q in C.ALL))
def connected_subsets(t: Tables) -> DataFrame:
    links = t.spark.createDataFrame([(q.qid, e.a, e.b) for q in C.ALL for e in q.edges], "qid string, a string, b string")
    nodes = t.spark.createDataFrame([(q.qid, a) for q in C.ALL for a in q.tables], "qid string, alias string")
    return edges.connected_subsets(links, nodes)


def edges_with_cards(t: Tables, q: JoinQuery) -> DataFrame:
    both = materialize(actual_and_total(t, q).withColumn("qid", F.lit(q.qid)), "cards")
    return edges.with_cards(edges.drop_one_edges(edges.subset_table(t.spark, [q])), both, "actual", "total")


@add(edges_sql(C.G5) + " SELECT 'g5' AS qid, big, small, other, c1, c2, c3, t1, t2 FROM g")
def plan_edges_g5(t: Tables) -> DataFrame:
    return edges_with_cards(t, C.G5)


add(edges_sql(C.G7) + " SELECT 'g7' AS qid, big, small, other, c1, c2, c3, t1, t2 FROM g", "plan_edges_g7")(lambda t: edges_with_cards(t, C.G7))


@add("SELECT * FROM (VALUES ('g3', 'c', 1.0::DOUBLE), ('g3', 'l', 1.0), ('g3', 'o', 1.0)) AS x(qid, big, cost)")
def source_edges(t: Tables) -> DataFrame:
    return edges.source_edges(edges.subset_table(t.spark, [C.G3])).select("qid", "big", "cost")


# ---- statistics and expected sizes

_STAT = "SELECT '{c}' AS col_name, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS num_values, count(*) AS total_values, count(*) - count({c}) AS null_values FROM title"


@add(" UNION ALL ".join(_STAT.format(c=c) for c in ("id", "title", "production_year", "kind_id", "episode_nr")))
def column_stats(t: Tables) -> DataFrame:
    return stats.column_stats(t.title, ["id", "title", "production_year", "kind_id", "episode_nr"])


_P = {"o": "1.0 / s.d_o_orderstatus", "c": "2.0 / s.d_c_mktsegment", "l": "least(1, greatest(0, 21.0 / (s.h_l_quantity - s.l_l_quantity)))", "p": "least(1, greatest(0, 30.0 / (s.h_p_size - s.l_p_size)))", "n": "3.0 / s.d_n_regionkey", "s": "least(1, greatest(0, (s.h_s_acctbal - 0.0) / (s.h_s_acctbal - s.l_s_acctbal)))"}
_J = {"cn": ("d_c_nationkey", "d_n_nationkey"), "co": ("d_o_custkey", "d_c_custkey"), "lo": ("d_l_orderkey", "d_o_orderkey"), "lp": ("d_l_partkey", "d_p_partkey"), "ls": ("d_l_suppkey", "d_s_suppkey")}


def _expected_sql(q: JoinQuery = C.G5) -> str:
    facts = {
        "c": ("customer", ("c_custkey", "c_nationkey", "c_mktsegment"), ()), "n": ("nation", ("n_nationkey", "n_regionkey"), ()),
        "o": ("orders", ("o_orderkey", "o_custkey", "o_orderstatus"), ()), "l": ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey"), ("l_quantity",)), "s": ("supplier", ("s_suppkey",), ("s_acctbal",)), "p": ("part", ("p_partkey",), ("p_size",)),
    }
    parts = []
    for a, (table, ndv, ranges) in ((a, f) for a, f in facts.items() if a in q.tables):
        parts.append(f"(SELECT count(*)::DOUBLE AS all_{a}, " + ", ".join([*(f"count(DISTINCT {c})::DOUBLE AS d_{c}" for c in ndv), *(f"min({c})::DOUBLE AS l_{c}, max({c})::DOUBLE AS h_{c}" for c in ranges)]) + f" FROM {table})")
    out = []
    for s in q.subsets():
        terms = [f"s.all_{a} * ({_P[a]})" if a in _P else f"s.all_{a}" for a in s]
        terms += [f"(1 / greatest(s.{x}, s.{y}))" for ab, (x, y) in _J.items() if set(ab) <= set(s)]
        out.append(f"SELECT '{q.qid}' AS qid, '{key(s)}' AS subset, {len(s)} AS n_tables, round(greatest(1, {' * '.join(terms)}), 4) AS value FROM s")
    return f"WITH s AS (SELECT * FROM {', '.join(parts)}) " + " UNION ALL ".join(out)


@add(_expected_sql())
def expected_g5(t: Tables) -> DataFrame:
    return stats.expected_counts(t.spark, t, C.G5).withColumn("value", F.round("value", 4))


# ---- costs


def _cost_query(model: str) -> None:
    add(edges_sql(C.G5) + f" SELECT big, small, round({_RULES[model]}, 4) AS cost FROM g", f"cost_{model}")(
        lambda t: costs.with_cost(edges_with_cards(t, C.G5), model).select("big", "small", F.round("cost", 4).alias("cost"))
    )


for _model in _RULES:
    _cost_query(_model)


@add(
    edges_sql(C.G5) + " SELECT big, small, CASE WHEN small NOT LIKE '% %' THEN CASE WHEN c1 * c2 < o + 0.001 * s THEN 'Seq Scan' ELSE 'Index Scan' END END AS scan_small,"
    " CASE WHEN c1 * c2 < o + 0.001 * s OR small NOT LIKE '% %' THEN 'Seq Scan' ELSE 'Index Scan' END AS scan_other FROM g"
)
def scan_labels(t: Tables) -> DataFrame:
    return costs.scan_labels(edges_with_cards(t, C.G5)).select("big", "small", "scan_small", "scan_other")


@add(
    edges_sql(C.G5) + ", x AS (SELECT *, CASE WHEN small NOT LIKE '% %' THEN small ELSE other END AS single, string_split(CASE WHEN small NOT LIKE '% %' THEN other ELSE small END, ' ') AS rest FROM g)"
    " SELECT big, small, round(least((o + c3 * ts / s) * CASE WHEN single IN ('l', 'p') AND NOT list_has_any(rest, ['o', 'c']) THEN 10 ELSE 1 END * CASE WHEN single IN ('n', 'c') THEN 1 ELSE 10 END, c1 * c2), 4) AS cost FROM x"
)
def cost_index13_facts(t: Tables) -> DataFrame:
    """Model 13 with fact, partner and clustered aliases of these tables."""
    return edges_with_cards(t, C.G5).select("big", "small", F.round(costs.index13(("l", "p"), ("o", "c"), ("n", "c")), 4).alias("cost"))


# ---- plan search

_I7 = _RULES["nested_loop_index7"]
_ALL5 = " UNION ALL ".join(f"SELECT subset, best, path FROM b{n}" for n in range(1, 6))


def _default_cost(t: Tables, q: JoinQuery = C.G5) -> DataFrame:
    return materialize(costs.with_cost(edges_with_cards(t, q)), "edges")


@add(edges_sql(C.G5) + ", " + dp_sql(C.G5, _I7) + f" SELECT subset, round(best, 4) AS best, path FROM ({_ALL5})")
def optimal_plan(t: Tables) -> DataFrame:
    return search.left_deep(_default_cost(t), "cost").select("subset", F.round("best", 4).alias("best"), "path")


add(edges_sql(C.G7) + ", " + dp_sql(C.G7, _I7) + " SELECT round(best, 4) AS best, path FROM b7", "optimal_plan_g7")(
    lambda t: search.left_deep(_default_cost(t, C.G7), "cost", full=True).select(F.round("best", 4).alias("best"), "path")
)


@add(edges_sql(C.G5) + ", " + dp_sql(C.G5, _I7) + ", h AS (SELECT string_split(path, ' ') AS p FROM b5) SELECT '((((' || p[1] || ' ' || p[2] || ') ' || p[3] || ') ' || p[4] || ') ' || p[5] || ')' AS hint, len(p)::BIGINT AS n FROM h")
def plan_path(t: Tables) -> DataFrame:
    """The join order as nested brackets."""
    best = search.left_deep(_default_cost(t), "cost", full=True)
    return best.select(search.leading_hint(F.col("path")).alias("hint"), F.size(F.split("path", " ")).cast("long").alias("n"))


_RULE_EST = "least(o2 + 0.001 * s2, k1 * k2)"
_EST_EDGES = (
    edges_sql(C.G5).replace("g AS (SELECT *,", "g1 AS (SELECT *,") + ", x AS (" + _expected_sql() + "), g AS (SELECT g1.*, y1.value AS k1, y2.value AS k2,"
    " CASE WHEN small NOT LIKE '% %' THEN y1.value ELSE y2.value END AS s2, CASE WHEN small NOT LIKE '% %' THEN y2.value ELSE y1.value END AS o2"
    " FROM g1 JOIN x AS y1 ON y1.subset = small JOIN x AS y2 ON y2.subset = other)"
)


def estimated_and_true(t: Tables, q: JoinQuery = C.G5) -> DataFrame:
    """Edges with true_cost and est_cost (textbook estimates), by the default model. Statistics and counts are gathered side by side."""
    with ThreadPoolExecutor(1) as pool:
        estimates = pool.submit(stats.expected_counts, t.spark, t, q)
        counted = materialize(cards.actual_and_total(t.spark, t, q), "cards")
        est = estimates.result().select("subset", F.round("value", 4).alias("est"))
    both = counted.join(F.broadcast(est), "subset")  # a row a subset
    every = edges.drop_one_edges(edges.subset_table(t.spark, [q]))
    return costs.with_both_costs(edges.with_cards(every, both, "actual", "total", "est"))


@add(
    _EST_EDGES + ", " + dp_sql(C.G5, _RULE_EST, _I7) + ", " + dp_sql(C.G5, _I7).replace("b1 AS", "d1 AS").replace(" b1 AS b ", " d1 AS b ")
    .replace("b2 AS (", "d2 AS (").replace("b3 AS (", "d3 AS (").replace("b4 AS (", "d4 AS (").replace("b5 AS (", "d5 AS (")
    .replace("JOIN b2", "JOIN d2").replace("JOIN b3", "JOIN d3").replace("JOIN b4", "JOIN d4").replace("JOIN b1", "JOIN d1")
    + " SELECT round(b5.carried, 4) AS est_plan_cost, round(d5.best, 4) AS best_cost, round(greatest(b5.carried - d5.best, 0), 4) AS loss FROM b5, d5"
)
def plan_loss(t: Tables) -> DataFrame:
    found = search.plan_loss(estimated_and_true(t), "true_cost", "est_cost")
    return found.select(*(F.round(c, 4).alias(c) for c in ("est_plan_cost", "best_cost", "loss")))


_PREFIXES = ", ".join(f"list_sort(string_split(path, ' ')[1:{n}])" for n in range(1, 6))


@add(edges_sql(C.G5) + ", " + dp_sql(C.G5, _I7) + f" SELECT array_to_string(u, ' ') AS subset FROM (SELECT unnest([{_PREFIXES}]) AS u FROM b5)")
def on_best_path(t: Tables) -> DataFrame:
    return search.path_flags(_default_cost(t), "cost").select("subset")


def _paths_sql(q: JoinQuery) -> str:
    n = len(q.tables)
    out = [f"WITH RECURSIVE {enumerated_sql(q)}, p{n} AS (SELECT '{key(tuple(q.tables))}' AS subset, 1.0::DOUBLE AS n_paths)"]
    out += [f"p{k - 1} AS (SELECT e.small AS subset, sum(n_paths) AS n_paths FROM e JOIN p{k} AS p ON p.subset = e.big GROUP BY 1)" for k in range(n, 1, -1)]
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(n, 0, -1))


@add(_paths_sql(C.G7))
def num_paths(t: Tables) -> DataFrame:
    return search.simple_paths(edges.drop_one_edges(edges.subset_table(t.spark, [C.G7]))).select("subset", "n_paths")


def _perturb_sql() -> str:
    head = edges_sql(C.G5).replace("g0 AS (", "g00 AS (").replace("g AS (SELECT *,", "h AS (SELECT *,").replace("FROM g0)", "FROM g00)")
    parts = []
    for m in (0.01, 1.0, 100.0):
        def scale(card: str, name: str) -> str:
            return f"greatest(CASE WHEN {name} = 'l o' THEN {card} * {m} ELSE {card} END, 1)"

        cte = f"""g0 AS (SELECT big, small, other, {scale('c1', 'small')} AS c1, {scale('c2', 'other')} AS c2, {scale('c3', 'big')} AS c3, t1, t2 FROM h),
g AS (SELECT *, CASE WHEN small NOT LIKE '% %' THEN c1 ELSE c2 END AS s, CASE WHEN small NOT LIKE '% %' THEN c2 ELSE c1 END AS o FROM g0)"""
        parts.append(f"(WITH {cte}, {dp_sql(C.G5, _I7)} SELECT {m}::DOUBLE AS m, round(best, 4) AS best, path FROM b5)")
    return head + " " + " UNION ALL ".join(parts)


@add(_perturb_sql())
def perturb_sweep(t: Tables) -> DataFrame:
    base = edges_with_cards(t, C.G5).withColumn("target", F.lit("l o"))
    varied = materialize(costs.with_cost(search.perturbed(base, "target", [0.01, 1.0, 100.0])), "sweep")
    found = search.left_deep(varied, "cost", full=True)
    return found.select(F.element_at(F.split("qid", r"\|"), 3).cast("double").alias("m"), F.round("best", 4).alias("best"), "path")


def _tolerance_sql() -> str:
    """Every sub-join's count times and over powers of ten, each a search of its own."""
    factors = [10.0**j for j in range(1, 5)] + [10.0**-j for j in range(1, 5)]
    targets = ", ".join(f"('{key(s)}')" for s in C.G5.subsets())
    scaled = ", ".join(f"greatest({c} * CASE WHEN {at} = target THEN m ELSE 1 END, 1) AS {c}" for c, at in (("c1", "small"), ("c2", "other")))
    single = "small NOT LIKE '% %'"
    variants = f"v0 AS (SELECT target, m, big, small, other, {scaled} FROM (SELECT * EXCLUDE (s, o, ts) FROM g), (VALUES {targets}) AS x(target), (SELECT unnest({factors}) AS m)), v AS (SELECT *, least(CASE WHEN {single} THEN c2 ELSE c1 END + 0.001 * CASE WHEN {single} THEN c1 ELSE c2 END, c1 * c2) AS cost FROM v0)"
    base = "b AS (SELECT 1 AS one, big, small, other, least(o + 0.001 * s, c1 * c2) AS cost FROM g)"
    return (
        edges_sql(C.G5) + f", {variants}, {base}, {dp_keyed_sql('v', 'w', 'target, m', 'cost', '0', 5)}, {dp_keyed_sql('b', 'd', 'one', 'cost', '0', 5)}"
        f" SELECT target AS subset, round(coalesce(min(greatest(m, 1 / m)) FILTER (w5.path <> d5.path), 100000))::BIGINT AS tolerance FROM w5, d5 GROUP BY 1"
    )


@add(_tolerance_sql())
def tolerance(t: Tables) -> DataFrame:
    """Smallest power of ten by which a sub-join's count may err before the best plan changes."""
    e = materialize(edges_with_cards(t, C.G5), "edges")
    return search.tolerance(e, costs.MODELS[costs.DEFAULT], edges.subset_table(t.spark, [C.G5])).select("subset", "tolerance")


def _bushy_sql(q: JoinQuery) -> str:
    subsets = set(q.subsets())
    rows = []
    for b in subsets:
        for left in subsets:
            right = tuple(x for x in b if x not in left)
            if set(left) < set(b) and right in subsets and key(left) < key(right):
                rows.append((key(b), key(left), key(right)))
    values = ", ".join(f"('{b}', '{x}', '{y}')" for b, x, y in rows)
    n = len(q.tables)
    out = f"WITH a AS ({counts_sql(q)}), e(big, l, r) AS (VALUES {values}), g AS (SELECT e.*, 0.001 * greatest(x.value, 1) + 0.001 * greatest(y.value, 1) AS cost FROM e JOIN a AS x ON x.subset = l JOIN a AS y ON y.subset = r)"
    out += ", b1 AS (SELECT subset, 0::DOUBLE AS best FROM a WHERE n_tables = 1)"
    for k in range(2, n + 1):
        out += f", b{k} AS (SELECT * FROM b{k - 1} UNION ALL SELECT big, min(cost + x.best + y.best) FROM g JOIN b{k - 1} AS x ON x.subset = l JOIN b{k - 1} AS y ON y.subset = r WHERE len(string_split(big, ' ')) = {k} GROUP BY 1)"
    return out + f" SELECT subset, round(best, 4) AS best FROM b{n}"


@add(_bushy_sql(C.G6))
def join_loss_bushy(t: Tables) -> DataFrame:
    """Cheapest bushy plan of every sub-join by the hash-join cost."""
    found = search.bushy(materialize(_splits(t, counted(t, C.G6), "cost"), "splits"), "cost")
    return found.select("subset", F.round("best", 4).alias("best"))


def _splits(t: Tables, counts: DataFrame, out: str) -> DataFrame:
    """Splits of G6 with their hash-join cost by given counts."""
    counts = materialize(counts, "cards")

    def side(name: str, c: str) -> DataFrame:
        return counts.select("qid", F.col("subset").alias(name), F.greatest(F.col("value").cast("double"), F.lit(1.0)).alias(c))

    splits = search.bushy_splits(edges.subset_table(t.spark, [C.G6])).join(side("left", "c1"), ["qid", "left"]).join(side("right", "c2"), ["qid", "right"])
    return splits.select("qid", "big", "left", "right", costs.hash_join().alias(out))


def _join_loss_sql() -> str:
    q, subsets = C.G6, set(C.G6.subsets())
    rows = []
    for b in subsets:
        for left in subsets:
            right = tuple(x for x in b if x not in left)
            if set(left) < set(b) and right in subsets and key(left) < key(right):
                rows.append(f"('{key(b)}', '{key(left)}', '{key(right)}')")
    cost = "0.001 * greatest({0}.value, 1) + 0.001 * greatest({1}.value, 1)"
    out = (
        f"WITH a AS ({counts_sql(q)}), x AS ({_expected_sql(q)}), e(big, l, r) AS (VALUES {', '.join(rows)}), g AS (SELECT e.*, {cost.format('a1', 'a2')} AS tc, {cost.format('x1', 'x2')} AS ec"
        " FROM e JOIN a AS a1 ON a1.subset = l JOIN a AS a2 ON a2.subset = r JOIN x AS x1 ON x1.subset = l JOIN x AS x2 ON x2.subset = r)"
    )
    for name, by in (("est", "ec"), ("opt", "tc")):
        out += f", {name}1 AS (SELECT subset, 0::DOUBLE AS best, subset AS tree, 0::DOUBLE AS carried FROM a WHERE n_tables = 1)"
        for k in range(2, len(q.tables) + 1):
            out += (
                f", {name}{k} AS (SELECT * FROM {name}{k - 1} UNION ALL SELECT big, best, tree, carried FROM (SELECT big, {by} + y.best + z.best AS best, '(' || y.tree || ' ' || z.tree || ')' AS tree,"
                f" tc + y.carried + z.carried AS carried, row_number() OVER (PARTITION BY big ORDER BY {by} + y.best + z.best, '(' || y.tree || ' ' || z.tree || ')') AS rank"
                f" FROM g JOIN {name}{k - 1} AS y ON y.subset = l JOIN {name}{k - 1} AS z ON z.subset = r WHERE len(string_split(big, ' ')) = {k}) WHERE rank = 1)"
            )
    n = len(q.tables)
    return out + f" SELECT 'g6' AS qid, round(greatest(e.carried, o.best), 4) AS est, round(o.best, 4) AS opt, round(greatest(e.carried, o.best) - o.best, 4) AS loss, round(greatest(e.carried, o.best) / o.best, 6) AS ratio FROM est{n} AS e JOIN opt{n} AS o USING (subset) WHERE len(string_split(subset, ' ')) = {n}"


@add(_join_loss_sql())
def join_loss(t: Tables) -> DataFrame:
    """Loss of the bushy plan that textbook estimates choose, by the hash-join cost under true counts."""
    true, est = _splits(t, counted(t, C.G6), "true_cost"), _splits(t, stats.expected_counts(t.spark, t, C.G6), "est_cost")
    both = materialize(true.join(est, ["qid", "big", "left", "right"]), "splits")
    return search.join_loss(both, "true_cost", "est_cost").withColumns({c: F.round(c, n) for c, n in (("est", 4), ("opt", 4), ("loss", 4), ("ratio", 6))})


@add()
def operator_histogram(t: Tables) -> DataFrame:
    """Join operators of the physical plans of two queries: nested, merge or hash."""
    spark = t.views("orders", "customer", "lineitem", "nation", "part")
    nodes = stats.physical_joins(spark, C.G3.count_sql()).unionByName(stats.physical_joins(spark, C.G5.count_sql()))
    return nodes.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@add(C.G5.count_sql(select="COUNT(*) AS n"))
def forced_join_order(t: Tables) -> DataFrame:
    """The query run in the order that the plan search chose."""
    path = search.left_deep(_default_cost(t), "cost", full=True).first()["path"]
    return C.G5.join(t, tuple(sorted(C.G5.tables)), order=path.split(" ")).agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLES = R.queries, R.oracles
