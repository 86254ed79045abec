"""Single steps of the larger operators, each beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators import cards as K
from joinlens.operators import estimators, models, pgm
from joinlens.operators import features as X
from joinlens.plans import costs, edges, flow
from joinlens.queries.base import Registry, Tables
from joinlens.queries.estimates import _COLUMNS, _JOINT, _MARGINAL, _model, known
from joinlens.queries.learned import _LINKS, _NODES
from joinlens.queries.plans import actual_and_total, edges_sql
from joinlens.queries.results import _PLANS, cards
from joinlens.session import materialize, scratch_path
from joinlens.sources import files
from joinlens.sources import qrep as Q
from joinlens.workload import catalog as C

R = Registry()
add = R.add
col = F.col

# ---- running and storing


@add("SELECT 'ok' AS status, count(*) AS n FROM orders")
def execute_with_timeout(t: Tables) -> DataFrame:
    status, rows = K.execute(t.views("orders"), "SELECT COUNT(*) AS n FROM orders", timeout=600.0)
    return t.spark.createDataFrame([(status, rows[0]["n"])], "status string, n long")


@add("SELECT unnest([1, 2]) AS asked, (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS n")
def cached_execute(t: Tables) -> DataFrame:
    """The second count comes from the cache."""
    cache = K.CountCache(t.views("lineitem"), scratch_path(t.spark, "counts"), threshold=0.0)
    return t.spark.createDataFrame([(i, cache.get("SELECT COUNT(*) FROM lineitem WHERE l_quantity > 25")) for i in (1, 2)], "asked int, n long")


@add("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def results_appended(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "results"), t.nation.select("n_nationkey", "n_name", "n_regionkey")
    files.write_results(rows.limit(1).drop("n_regionkey"), path)
    files.write_results(rows.drop("n_regionkey"), path, append=False)
    files.write_results(rows.where("n_regionkey = 1").drop("n_regionkey"), path)
    return files.read_results(t.spark, path)


@add(r"SELECT regexp_replace(sql, '[\r\n]+', ' ', 'g') AS value, count(*) AS n FROM qrep WHERE sql IS NOT NULL GROUP BY 1")
def sql_dump(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "dump")
    files.dump_sql(t.qrep.where("sql IS NOT NULL"), path)
    return t.spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@add(f"WITH {_PLANS} SELECT kind, count(*) AS n, sum(value)::DOUBLE AS total FROM (SELECT 'actual' AS kind, actual AS value FROM cards UNION ALL SELECT 'expected', expected FROM cards UNION ALL SELECT 'total', total FROM cards) WHERE value IS NOT NULL GROUP BY 1")
def counts_by_kind(t: Tables) -> DataFrame:
    return Q.long_cards(cards(t)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# ---- filters of texts


@add(r"SELECT qid, len(regexp_extract_all(sql, '[^<>!=]=\s*[''\x22+\-0-9.]')) AS n FROM qrep WHERE sql IS NOT NULL")
def equality_filters(t: Tables) -> DataFrame:
    """Equalities with a constant, also with one that holds a dot: these are no joins."""
    found = X.workload_filters(t.qrep, "qid", "sql").groupBy("qid").agg(F.count_if(col("op") == "eq").alias("n"))
    return t.qrep.where("sql IS NOT NULL").select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


@add(
    r"SELECT qid, len(list_distinct(regexp_extract_all(lower(sql), '([a-z0-9_.]+)\s*(?:<=|>=|<[^>=]|>[^=])', 1))) + len(regexp_extract_all(lower(sql), '\sbetween\s')) AS n FROM qrep WHERE sql IS NOT NULL"
)
def range_filters(t: Tables) -> DataFrame:
    """Ranges, those with two sides once."""
    found = X.workload_filters(t.qrep, "qid", "sql").groupBy("qid").agg(F.count_if(col("op") == "lt").alias("n"))
    return t.qrep.where("sql IS NOT NULL").select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


# ---- features


@add(f"WITH {_NODES} SELECT real_name, (row_number() OVER (ORDER BY real_name) - 1)::INT AS slot FROM (SELECT DISTINCT real_name FROM nd WHERE real_name IS NOT NULL)")
def table_vocabulary(t: Tables) -> DataFrame:
    return X.vocabulary(Q.join_nodes(t.qrep), "real_name")


@add(
    f"WITH {_PLANS}, {_NODES}, {_LINKS}, k AS (SELECT qid, subset FROM cards WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL),"
    " i AS (SELECT k.qid, k.subset, count(*) AS n FROM k JOIN lk ON lk.qid = k.qid AND list_contains(string_split(subset, ' '), a1) AND list_contains(string_split(subset, ' '), a2) GROUP BY 1, 2),"
    " m AS (SELECT k.qid, k.subset, count(*) AS n FROM k JOIN nd ON nd.qid = k.qid AND list_contains(string_split(subset, ' '), alias) WHERE real_name IS NOT NULL GROUP BY 1, 2)"
    " SELECT k.qid, k.subset, coalesce(m.n, 0) AS n_tables, coalesce(i.n, 0) AS n_joins FROM k LEFT JOIN i USING (qid, subset) LEFT JOIN m USING (qid, subset)"
)
def set_sizes(t: Tables) -> DataFrame:
    """Elements of the sets that the network sees: tables and joins of every sub-plan."""
    sets, _ = X.set_features(known(t), Q.join_nodes(t.qrep), Q.join_edges(t.qrep), materialize(X.workload_filters(t.qrep, "qid", "sql"), "filters"))
    none = F.array().cast("array<int>")  # graphs that do not fit their sub-plans have no elements
    return sets.select("qid", "subset", *(F.size(F.coalesce(c, none)).cast("long").alias(f"n_{c}") for c in ("tables", "joins")))


@add(
    f"WITH {_PLANS} SELECT template, round(sum(x * x), 4) AS energy FROM (SELECT nullif(regexp_replace(lower(template_name), '[^a-z0-9]', '', 'g'), '') AS template, ln(greatest(actual, 1)) AS x FROM cards"
    " WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL) WHERE template IS NOT NULL GROUP BY 1"
)
def singular_trace(t: Tables) -> DataFrame:
    """The squares of a matrix's singular values add up to those of its cells."""
    key = F.nullif(F.regexp_replace(F.lower("template_name"), "[^a-z0-9]", ""), F.lit(""))
    logs = known(t).select(key.alias("template"), "subset", "qid", F.ln(F.greatest("actual", F.lit(1))).alias("x")).where("template IS NOT NULL")
    found = models.singular_energy(logs, "template", "qid", "subset", "x")
    return found.groupBy("template").agg(F.round(F.sum(col("singular") * col("singular")), 4).alias("energy"))


# ---- estimators


_BOUNDS = f"WITH {_PLANS}, k AS (SELECT count(*) AS n FROM cards WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL) SELECT n, n AS n_within FROM k"


@add(_BOUNDS)
def est_random_bounds(t: Tables) -> DataFrame:
    plans = materialize(known(t), "cards")
    both = estimators.estimate("random", plans).join(plans, ["qid", "subset"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if((col("est") >= 0) & (col("est") <= col("total"))).alias("n_within"))


@add(_BOUNDS)
def est_true_random_bounds(t: Tables) -> DataFrame:
    """Off by half the truth at most, 1 at least."""
    plans = materialize(known(t), "cards")
    both = estimators.estimate("true_random", plans, percent=50.0).join(plans, ["qid", "subset"])
    inside = (col("est") >= F.greatest(F.lit(1.0), col("actual") * 0.5 - 1e-6)) & (col("est") <= F.greatest(F.lit(1.0), col("actual") * 1.5 + 1e-6))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_within"))


# ---- tree models

_MI = (
    f"WITH m AS ({_MARGINAL}), j AS ({_JOINT}), i AS (SELECT j.a, j.b, sum(j.p * ln(j.p / (x.p * y.p))) AS mi FROM j JOIN m AS x ON x.col_name = j.a AND x.value = j.va JOIN m AS y ON y.col_name = j.b AND y.value = j.vb GROUP BY 1, 2),"
    " e AS (SELECT a, b FROM i ORDER BY mi DESC, a, b LIMIT 2), c AS (SELECT col_name, count(*) AS n FROM m GROUP BY 1)"
)


@add(_MI + " SELECT least(e.a, e.b) AS x, greatest(e.a, e.b) AS y, (SELECT sum(n) FROM c)::BIGINT + (SELECT sum(p.n * q.n) FROM e AS f JOIN c AS p ON p.col_name = f.a JOIN c AS q ON q.col_name = f.b)::BIGINT AS n_parameters FROM e")
def pgm_tree_edges(t: Tables) -> DataFrame:
    """The spanning tree of three columns (its two strongest pairs) and the numbers that the model stores."""
    joint, marginal = _model(t)
    tree = pgm.spanning_tree([tuple(r) for r in pgm.mutual_information(joint, marginal).collect()])  # a row a pair of columns
    size = pgm.parameter_count(marginal, tree)
    return t.spark.createDataFrame([(min(e), max(e), size) for e in tree], "x string, y string, n_parameters long")


@add(f"WITH m AS ({_MARGINAL}) SELECT 1 AS qid, round(sum(p * CASE value WHEN 'A' THEN 0.25 WHEN 'N' THEN 1 ELSE 0 END), 6) AS p FROM m WHERE col_name = 'l_returnflag'")
def pgm_partial_bin(t: Tables) -> DataFrame:
    """A bin that a filter covers by a quarter."""
    joint, marginal = _model(t)
    filters = t.spark.createDataFrame([(1, "l_returnflag", "A", 0.25), (1, "l_returnflag", "N", 1.0)], "qid int, col_name string, value string, weight double")
    tree = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber")]
    return pgm.infer(joint, marginal, tree, t.spark.createDataFrame([(1,)], "qid int"), filters).withColumn("p", F.round("p", 6))


@add("SELECT 1 AS qid, round(count(*) FILTER (WHERE l_returnflag = 'A' AND l_linenumber IN (1, 2)) / count(*), 6) AS p FROM lineitem")
def pgm_restricted(t: Tables) -> DataFrame:
    """A tree over the filtered columns alone: exact for two."""
    joint, marginal = _model(t)
    mi = [tuple(r) for r in pgm.mutual_information(joint, marginal).collect()]  # a row a pair of columns
    tree = pgm.spanning_tree(mi, {"l_returnflag", "l_linenumber"})
    filters = t.spark.createDataFrame([(1, "l_returnflag", "A"), (1, "l_linenumber", "1"), (1, "l_linenumber", "2")], "qid int, col_name string, value string")
    return pgm.infer(joint, marginal, tree, t.spark.createDataFrame([(1,)], "qid int"), filters).withColumn("p", F.round("p", 6))


@add(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(sum(p * p), 6) AS energy FROM ({_JOINT}) WHERE a = '{a}' AND b = '{b}'" for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"))
    )
)
def pgm_full_rank(t: Tables) -> DataFrame:
    """Joints rebuilt from all their singular values hold what they held."""
    found = pgm.low_rank(_model(t)[0], len(_COLUMNS) * 100)
    return found.groupBy("a", "b").agg(F.round(F.sum(col("p") * col("p")), 6).alias("energy"))


# ---- flows

_TWO = C.tpch("g2", "co")


def _two(t: Tables) -> DataFrame:
    both = materialize(actual_and_total(t, _TWO).withColumn("qid", F.lit("g2")), "cards")
    return materialize(costs.with_cost(edges.with_cards(edges.drop_one_edges(edges.subset_table(t.spark, [_TWO])), both, "actual", "total")), "edges")


_NETWORK = edges_sql(_TWO) + ", r AS (SELECT small, least(o + 0.001 * s, c1 * c2) AS cost FROM g), f AS (SELECT small, cost, (1 / (cost + 1)) / sum(1 / (cost + 1)) OVER () AS flow FROM r)"


@add(_NETWORK + " SELECT 'g2' AS qid, round(sum((cost + 1) * flow * flow), 4) AS flow_loss FROM f")
def flow_loss_two(t: Tables) -> DataFrame:
    """Two tables: two paths side by side, which share the current by their conductances."""
    return flow.flow_loss(flow.flows(_two(t), "cost", "cost")).select("qid", F.round("flow_loss", 4).alias("flow_loss"))


@add(_NETWORK + " SELECT 'g2' AS qid, small AS subset, round(flow, 6) AS importance FROM f UNION ALL SELECT 'g2', 'c o', 1")
def node_importance_two(t: Tables) -> DataFrame:
    return flow.node_importance(flow.flows(_two(t), "cost", "cost")).withColumn("importance", F.round("importance", 6))


@add(_NETWORK + ", k AS (SELECT *, (1 / (cost + 1)) AS c, sum(1 / (cost + 1)) OVER () AS w, sum(flow * flow * (cost + 1)) OVER () AS loss FROM f)"
     " SELECT 'g2' AS qid, 'c o' AS big, small, round(2 * flow * c * (loss - (cost + 1) * flow), 6) AS gradient FROM k")  # fmt: skip
def flow_gradient_two(t: Tables) -> DataFrame:
    """Gradient by the estimated costs where these are the true ones, from the closed form of two paths."""
    both = _two(t).withColumn("true", col("cost"))
    return flow.gradients(both, "cost", "true").where("big = 'c o'").select("qid", "big", "small", F.round("gradient", 6).alias("gradient"))


QUERIES, ORACLES = R.queries, R.oracles
