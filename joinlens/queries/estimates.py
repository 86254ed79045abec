"""Samples, snapshots, estimators, walks and probability models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators import estimators, features, pgm, sampling
from joinlens.plans import costs, edges, flow, search
from joinlens.queries.base import Registry, Tables
from joinlens.queries.plans import counted, edges_with_cards, estimated_and_true
from joinlens.queries.results import _PLANS, cards
from joinlens.session import materialize
from joinlens.workload import catalog as C
from joinlens.workload.spec import key

R = Registry()
add = R.add
col = F.col


def _draw(k: str, seed: int = 0) -> str:
    return f"(({k} * 950706376 + {seed}) % 2147483647)"


_TENTH = int(0.1 * 2147483647)

# ---- samples and snapshots


@add(f"SELECT o_orderkey, o_custkey FROM orders WHERE {_draw('o_orderkey')} < {_TENTH}")
def hash_sample(t: Tables) -> DataFrame:
    return sampling.hash_sample(t.orders, "o_orderkey", 0.1).select("o_orderkey", "o_custkey")


@add(f"SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'customer', count(*) FROM customer WHERE {_draw('c_custkey')} < {_TENTH} OR (SELECT count(*) FROM customer) < 1000")
def sample_small_tables(t: Tables) -> DataFrame:
    region = sampling.sample_or_all(t.region, "r_regionkey", 0.1).agg(F.count(F.lit(1)).alias("n")).select(F.lit("region").alias("name"), "n")
    return region.unionByName(sampling.sample_or_all(t.customer, "c_custkey", 0.1).agg(F.count(F.lit(1)).alias("n")).select(F.lit("customer").alias("name"), "n"))


@add(
    f"WITH s AS (SELECT * FROM orders WHERE {_draw('o_orderkey', 3)} < {_TENTH}) SELECT c_custkey, c_nationkey FROM customer"
    f" WHERE {_draw('c_custkey', 3)} < {_TENTH} OR c_custkey IN (SELECT o_custkey FROM s)"
)
def sample_topup(t: Tables) -> DataFrame:
    made = sampling.sample_database(t, {"orders": "o_orderkey", "customer": "c_custkey"}, [("orders", "o_custkey", "customer", "c_custkey")], 0.1, 3)
    return made["customer"].select("c_custkey", "c_nationkey")


@add(f"SELECT count(*) AS n FROM movie_info WHERE movie_id IN (SELECT id FROM title WHERE {_draw('id', 5)} < {_TENTH})")
def key_consistent_sample(t: Tables) -> DataFrame:
    ids = sampling.hash_sample(t.title, "id", 0.1, 5).select("id")
    return sampling.consistent_sample(t, ids, [("movie_info", "movie_id")])["movie_info"].agg(F.count(F.lit(1)).alias("n"))


_SNAP = """WITH t AS (SELECT * FROM title WHERE NOT coalesce(production_year > 1990, false)),
m AS (SELECT * FROM movie_info WHERE movie_id IN (SELECT id FROM t)), i AS (SELECT * FROM info_type WHERE id IN (SELECT info_type_id FROM m))"""


@add(_SNAP + " SELECT 'title' AS name, count(*) AS n FROM t UNION ALL SELECT 'movie_info', count(*) FROM m UNION ALL SELECT 'info_type', count(*) FROM i")
def snapshot_cascade(t: Tables) -> DataFrame:
    made = sampling.snapshot(t, "title", lambda: col("production_year") <= 1990, [("movie_info", "movie_id", "id")], [("info_type", "id", "movie_info", "info_type_id")])
    out = [made[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("title", "movie_info", "info_type")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _sampled_sql() -> str:
    q, out = C.G3, []
    names = {"orders": f"(SELECT * FROM orders WHERE {_draw('o_orderkey')} < {_TENTH})"}
    for s in q.subsets():
        sql = q.count_sql(s)
        scale = 1
        if "o" in s:
            sql, scale = sql.replace("orders AS o", names["orders"] + " AS o"), 10
        out.append(f"SELECT 'g3' AS qid, '{key(s)}' AS subset, greatest(({sql}) * {scale}.0, 1.0)::DOUBLE AS est")
    return " UNION ALL ".join(out)


@add(_sampled_sql())
def est_hash_sample(t: Tables) -> DataFrame:
    return sampling.sampled_counts(t.spark, t, C.G3, {"orders": "o_orderkey"}, 0.1).select("qid", "subset", col("value").alias("est"))


_OLD = "(SELECT * FROM orders WHERE NOT coalesce(o_orderdate > TIMESTAMP '1998-01-01', false))"


@add(" UNION ALL ".join(f"SELECT 'g3' AS qid, '{key(s)}' AS subset, greatest(({C.G3.count_sql(s).replace('orders AS o', _OLD + ' AS o')}), 1)::DOUBLE AS est" for s in C.G3.subsets()))
def est_snapshot(t: Tables) -> DataFrame:
    """Counts on the state before 1998 (facts keep rows whose order vanished: they are counted through the join)."""
    before = F.coalesce(col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp"), F.lit(True))
    found = counted(Tables2(t, {"orders": lambda: t.orders.where(before)}), C.G3)
    return estimators.estimate("olddb", found, column="value")


class Tables2:
    """Tables with some of them replaced."""

    def __init__(self, base: Tables, replaced: dict):
        self.base, self.replaced, self.spark = base, replaced, base.spark

    def __call__(self, name: str) -> DataFrame:
        return self.replaced[name]() if name in self.replaced else self.base(name)


@add("SELECT round((SELECT count(*) FROM lineitem) * count(*) FILTER (WHERE l_quantity >= 10 AND l_quantity < 20) / count(*), 4) AS estimate FROM lineitem WHERE " + f"{_draw('l_orderkey')} < {_TENTH}")
def scan_estimate(t: Tables) -> DataFrame:
    sample = sampling.hash_sample(t.lineitem, "l_orderkey", 0.1)
    made = sampling.scan_estimate(sample, t.lineitem.count(), (col("l_quantity") >= 10) & (col("l_quantity") < 20))
    return made.withColumn("estimate", F.round("estimate", 4))


@add(f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN {_draw('qid', 9)} < {int(0.5 * 2147483647)} THEN 'train' WHEN {_draw('qid', 9)} < {int(0.7 * 2147483647)} THEN 'val' ELSE 'test' END AS split FROM qrep) GROUP BY 1")
def hash_split(t: Tables) -> DataFrame:
    at = sampling.draw("qid", 9)
    split = F.when(at < int(0.5 * sampling.MODULUS), "train").when(at < int(0.7 * sampling.MODULUS), "val").otherwise("test")
    return t.qrep.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


_TEMPLATE = "nullif(regexp_replace(lower(template_name), '[^a-z0-9]', '', 'g'), '')"


@add(
    f"WITH k AS (SELECT {_TEMPLATE} AS template_key, min(qid) AS q, count(*) AS n FROM qrep GROUP BY 1) SELECT template_key, n,"
    f" CASE WHEN {_draw('q', 5)} < {int(0.5 * 2147483647)} THEN 'train' WHEN {_draw('q', 5)} < {int(0.7 * 2147483647)} THEN 'val' ELSE 'test' END AS split FROM k WHERE template_key IS NOT NULL"
)
def template_split(t: Tables) -> DataFrame:
    """Whole templates drawn into splits, by their first query."""
    key = F.nullif(F.regexp_replace(F.lower("template_name"), "[^a-z0-9]", ""), F.lit(""))
    keys = t.qrep.groupBy(key.alias("template_key")).agg(F.min("qid").alias("q"), F.count(F.lit(1)).alias("n")).where("template_key IS NOT NULL")
    at = sampling.draw("q", 5)
    return keys.select("template_key", "n", F.when(at < int(0.5 * sampling.MODULUS), "train").when(at < int(0.7 * sampling.MODULUS), "val").otherwise("test").alias("split"))


_NO = "floor(((d.i + 1) * 950706376 % 2147483647) * (SELECT count(*) FROM supplier) / 2147483647)"


@add(
    f"SELECT d.i AS draw_no, s.s_suppkey FROM (SELECT unnest(range(50)) AS i) AS d JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier) AS s ON s.r = {_NO}"
)
def draw_with_replacement(t: Tables) -> DataFrame:
    return sampling.replicated_draws(t.supplier, 50, ["s_suppkey"]).select("draw_no", "s_suppkey")


@add(
    "WITH s AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) AS hi, sum(p_size) OVER () AS total FROM part)"
    " SELECT d.i AS draw_no, s.p_partkey FROM (SELECT unnest(range(40)) AS i) AS d JOIN s ON ((d.i + 1) * 950706376 % 2147483647) / 2147483647 * total >= hi - p_size"
    " AND ((d.i + 1) * 950706376 % 2147483647) / 2147483647 * total < hi"
)
def weighted_draws(t: Tables) -> DataFrame:
    return sampling.weighted_draws(t.part, 40, "p_size", ["p_partkey"]).select("draw_no", "p_partkey")


# ---- estimators over stored counts

_KNOWN = f"WITH {_PLANS}, k AS (SELECT * FROM cards WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL)"


def known(t: Tables) -> DataFrame:
    return materialize(cards(t).where("actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL"), "cards")


add(_KNOWN + " SELECT qid, subset, expected::DOUBLE AS est FROM k", "est_planner")(lambda t: estimators.estimate("postgres", known(t)))
add(_KNOWN + " SELECT qid, subset, actual::DOUBLE AS est FROM k", "est_true")(lambda t: estimators.estimate("true", known(t)))
_RANK = "max(expected) OVER (PARTITION BY {} ORDER BY actual, subset ROWS UNBOUNDED PRECEDING)::DOUBLE"
add(_KNOWN + f" SELECT qid, subset, {_RANK.format('qid')} AS est FROM k", "est_true_rank")(lambda t: estimators.estimate("true_rank", known(t)))
add(_KNOWN + f" SELECT qid, subset, {_RANK.format('qid, n_tables')} AS est FROM k", "est_true_rank_tables")(lambda t: estimators.estimate("true_rank_tables", known(t)))


@add(
    _KNOWN + ", s AS (SELECT qid, subset AS a, least(1.0, greatest(actual, 1) / greatest(total, 1)) AS s FROM k WHERE n_tables = 1),"
    " p AS (SELECT qid, subset, total, unnest(string_split(subset, ' ')) AS a FROM k)"
    " SELECT qid, subset, round(greatest(1.0, total * exp(sum(ln(s)))), 3) AS est FROM p JOIN s USING (qid, a) GROUP BY qid, subset, total"
)
def est_independent(t: Tables) -> DataFrame:
    return estimators.estimate("independent", known(t)).withColumn("est", F.round("est", 3))


@add(_KNOWN + " SELECT qid, subset, CASE WHEN n_tables <= 2 THEN actual::DOUBLE ELSE expected::DOUBLE END AS est FROM k")
def est_saved_fallback(t: Tables) -> DataFrame:
    base = known(t)
    saved = base.where("n_tables <= 2").select("qid", "subset", col("actual").cast("double").alias("est"))
    return estimators.estimate("saved", base, predictions=saved)


@add(
    f"WITH {_PLANS}, l AS (SELECT qid, list_distinct(regexp_extract_all(lower(sql), '([a-z0-9_]+)\\.[a-z0-9_]+\\s+(?:not\\s+)?i?like\\s', 1)) AS a FROM qrep)"
    " SELECT qid, subset, (CASE WHEN len(list_intersect(a, string_split(subset, ' '))) > 0 THEN actual ELSE expected END)::DOUBLE AS est"
    " FROM cards JOIN l USING (qid) WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL"
)
def est_regex(t: Tables) -> DataFrame:
    """The truth for sub-plans with a pattern on one of their own tables."""
    kept = materialize(known(t), "cards")
    patterns = features.workload_filters(t.qrep, "qid", "sql").where("op IN ('like', 'not_like')").select("qid", "alias").distinct()
    flagged = features.members(kept).join(patterns, ["qid", "alias"]).select("qid", "subset", F.lit(True).alias("p")).distinct()
    return estimators.estimate("regex", kept.join(flagged, ["qid", "subset"], "left").withColumn("p", F.coalesce("p", F.lit(False))), has_pattern="p")


@add()
def est_random(t: Tables) -> DataFrame:
    return estimators.estimate("random", known(t))


@add()
def est_true_random(t: Tables) -> DataFrame:
    return estimators.estimate("true_random", known(t))


# ---- walks


def _walk_sql(walks: int) -> str:
    """Walks o -> c -> l of G3 by the arithmetic pick."""
    m, k = 2147483647, 950706376
    return f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS no, count(*) OVER () AS sz FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')),
c AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_custkey) - 1 AS no, count(*) OVER (PARTITION BY c_custkey) AS sz FROM (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey) - 1 AS no, count(*) OVER (PARTITION BY l_orderkey) AS sz FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 9 AND l_quantity <= 30)),
w0 AS (SELECT i AS w, (i + 1) * {k} % {m} AS x0 FROM (SELECT unnest(range({walks})) AS i)),
w1 AS (SELECT w, x0 * {k} % {m} AS x1, o.sz::DOUBLE AS f1, o_custkey, o_orderkey FROM w0 JOIN o ON o.no = floor(x0 * sz / {m})),
w2 AS (SELECT w, x1 * {k} % {m} AS x2, CASE WHEN c.sz IS NULL THEN 0 ELSE f1 * c.sz END AS f2, f1, o_orderkey FROM w1 LEFT JOIN c ON c.c_custkey = w1.o_custkey AND c.no = floor(x1 * c.sz / {m})),
w3 AS (SELECT w, f1, f2, CASE WHEN l.sz IS NULL THEN 0 ELSE f2 * l.sz END AS f3 FROM w2 LEFT JOIN l ON l.l_orderkey = w2.o_orderkey AND l.no = floor(x2 * l.sz / {m}))
SELECT subset, ceil(avg(f))::BIGINT AS estimate, round(stddev_samp(f), 3) AS sd, round(2.5758293035489004 * stddev_samp(f) / sqrt({walks}), 3) AS half_interval FROM (SELECT 'o' AS subset, f1 AS f FROM w3 UNION ALL SELECT 'c o', f2 FROM w3 UNION ALL SELECT 'c l o', f3 FROM w3) GROUP BY 1"""


@add(_walk_sql(2000))
def wander_join(t: Tables) -> DataFrame:
    found = sampling.wander_join(t.spark, t, C.G3, 2000, order=["o", "c", "l"])
    return found.select("subset", "estimate", F.round("sd", 3).alias("sd"), F.round("half_interval", 3).alias("half_interval"))


# ---- tree models

_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_MARGINAL = " UNION ALL ".join(f"SELECT '{c}' AS col_name, {c}::VARCHAR AS value, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 2" for c in _COLUMNS)
_PAIRS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")]
_JOINT = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::VARCHAR AS va, {b}::VARCHAR AS vb, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 3, 4" for a, b in _PAIRS)


def _model(t: Tables) -> tuple[DataFrame, DataFrame]:
    freq = materialize(pgm.frequency(t.lineitem, _COLUMNS), "pgm")
    return pgm.joints(freq, _COLUMNS), pgm.marginals(freq, _COLUMNS)


@add(f"SELECT col_name, value, round(p, 8) AS p FROM ({_MARGINAL})")
def pgm_marginals(t: Tables) -> DataFrame:
    return _model(t)[1].withColumn("p", F.round("p", 8))


@add("SELECT p_brand AS value, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def pgm_alphabet(t: Tables) -> DataFrame:
    return pgm.alphabet(pgm.frequency(t.part, ["p_brand"]), "p_brand")


@add(
    f"WITH m AS ({_MARGINAL}), j AS ({_JOINT}) SELECT j.a, j.b, round(sum(j.p * ln(j.p / (x.p * y.p))), 6) AS mi FROM j"
    " JOIN m AS x ON x.col_name = j.a AND x.value = j.va JOIN m AS y ON y.col_name = j.b AND y.value = j.vb GROUP BY 1, 2"
)
def pgm_mutual_info(t: Tables) -> DataFrame:
    joint, marginal = _model(t)
    return pgm.mutual_information(joint, marginal).withColumn("mi", F.round("mi", 6))


@add(
    f"WITH m AS ({_MARGINAL}), j AS ({_JOINT}), q(qid) AS (VALUES (1), (2), (3)), f(qid, col_name, value) AS (VALUES (1, 'l_returnflag', 'A'), (1, 'l_linenumber', '1'), (1, 'l_linenumber', '2'), (2, 'l_linestatus', 'F')),"
    " a AS (SELECT q.qid, m.col_name, m.value FROM q, m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.qid = q.qid AND f.col_name = m.col_name) OR EXISTS (SELECT 1 FROM f WHERE f.qid = q.qid AND f.col_name = m.col_name AND f.value = m.value)),"
    " s AS (SELECT a.qid, j.va AS v, sum(j.p / x.p) AS m FROM j JOIN a ON a.col_name = 'l_linestatus' AND a.value = j.vb JOIN m AS x ON x.col_name = 'l_returnflag' AND x.value = j.va WHERE j.a = 'l_returnflag' AND j.b = 'l_linestatus' GROUP BY 1, 2),"
    " n AS (SELECT a.qid, j.va AS v, sum(j.p / x.p) AS m FROM j JOIN a ON a.col_name = 'l_linenumber' AND a.value = j.vb JOIN m AS x ON x.col_name = 'l_returnflag' AND x.value = j.va WHERE j.a = 'l_returnflag' AND j.b = 'l_linenumber' GROUP BY 1, 2)"
    " SELECT a.qid, round(sum(s.m * n.m * x.p), 6) AS p FROM a JOIN s ON s.qid = a.qid AND s.v = a.value JOIN n ON n.qid = a.qid AND n.v = a.value JOIN m AS x ON x.col_name = 'l_returnflag' AND x.value = a.value WHERE a.col_name = 'l_returnflag' GROUP BY 1"
)
def pgm_infer(t: Tables) -> DataFrame:
    joint, marginal = _model(t)
    queries = t.spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    filters = t.spark.createDataFrame([(1, "l_returnflag", "A"), (1, "l_linenumber", "1"), (1, "l_linenumber", "2"), (2, "l_linestatus", "F")], "qid int, col_name string, value string")
    tree = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber")]
    return pgm.infer(joint, marginal, tree, queries, filters).withColumn("p", F.round("p", 6))


@add()
def pgm_tree_fit(t: Tables) -> DataFrame:
    """Tree learned from customers and orders, and the estimate of a filter by it."""
    table = t.orders.join(t.customer, col("o_custkey") == col("c_custkey")).select("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey")
    joint, marginal, tree = pgm.fit(table, table.columns)
    queries = t.spark.createDataFrame([(1,)], "qid int")
    filters = t.spark.createDataFrame([(1, "o_orderstatus", "F"), (1, "c_mktsegment", "BUILDING")], "qid int, col_name string, value string")
    size = pgm.parameter_count(marginal, tree)
    return pgm.infer(joint, marginal, tree, queries, filters).withColumn("tree", F.lit(" ".join(f"{a}>{b}" for a, b in tree))).withColumn("n_parameters", F.lit(size))


@add()
def pgm_sampled_join(t: Tables) -> DataFrame:
    """A tree learned from a sample of customers and all their orders, and the size of a filtered join by it."""
    ids = sampling.hash_sample(t.customer, "c_custkey", 0.2).select(col("c_custkey").alias("id"))
    made = sampling.consistent_sample(t, ids, [("orders", "o_custkey"), ("customer", "c_custkey")])
    table = made["orders"].join(made["customer"], col("o_custkey") == col("c_custkey")).select("o_orderstatus", "o_orderpriority", "c_mktsegment")
    joint, marginal, tree = pgm.fit(table, table.columns)
    filters = t.spark.createDataFrame([(1, "o_orderstatus", "F"), (1, "c_mktsegment", "BUILDING"), (2, "o_orderpriority", "1-URGENT")], "qid int, col_name string, value string")
    found = pgm.infer(joint, marginal, tree, t.spark.createDataFrame([(1,), (2,)], "qid int"), filters)
    return found.withColumn("est", F.ceil(col("p") * table.count() / 0.2))


@add(
    f"WITH m AS ({_MARGINAL}), j AS ({_JOINT}), e AS (SELECT * FROM j WHERE a = 'l_returnflag'), q(qid, r, s, n) AS (VALUES (1, 'A', 'F', '1'), (2, 'N', 'O', '3'), (3, 'R', 'O', '2'))"
    " SELECT q.qid, round(coalesce(r.p * s.p * n.p * (1 + (coalesce(u.p, 0) / (r.p * s.p) - 1) + (coalesce(w.p, 0) / (r.p * n.p) - 1)), 0), 8) AS p FROM q"
    " LEFT JOIN m AS r ON r.col_name = 'l_returnflag' AND r.value = q.r LEFT JOIN m AS s ON s.col_name = 'l_linestatus' AND s.value = q.s LEFT JOIN m AS n ON n.col_name = 'l_linenumber' AND n.value = q.n"
    " LEFT JOIN e AS u ON u.b = 'l_linestatus' AND u.va = q.r AND u.vb = q.s LEFT JOIN e AS w ON w.b = 'l_linenumber' AND w.va = q.r AND w.vb = q.n"
)
def pgm_pairwise(t: Tables) -> DataFrame:
    """Points by independence and a correction for each edge, from all its singular vectors."""
    joint, marginal = _model(t)
    points = [(q, c, v) for q, values in ((1, "AF1"), (2, "NO3"), (3, "RO2")) for c, v in zip(_COLUMNS, values, strict=True)]
    found = pgm.pairwise(pgm.corrections(joint, marginal, 10), marginal, [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber")], t.spark.createDataFrame(points, "qid int, col_name string, value string"))
    return found.withColumn("p", F.round("p", 8))


@add()
def pgm_low_rank(t: Tables) -> DataFrame:
    return pgm.low_rank(_model(t)[0], 2)


# ---- flows


def _flows(t: Tables) -> DataFrame:
    return materialize(flow.flows(materialize(estimated_and_true(t), "edges2"), "est_cost", "true_cost"), "flows")


@add()
def flow_loss(t: Tables) -> DataFrame:
    return flow.flow_loss(_flows(t))


@add()
def flow_power(t: Tables) -> DataFrame:
    """Flows under a power other than two, and the path that follows the largest flow."""
    return flow.flows(materialize(estimated_and_true(t), "edges2"), "est_cost", "true_cost", power=4.0, rounds=20)


@add()
def flow_gradient(t: Tables) -> DataFrame:
    return flow.gradients(materialize(estimated_and_true(t), "edges2"), "est_cost", "true_cost")


@add()
def flow_gradient_by_count(t: Tables) -> DataFrame:
    """Gradient of the flow loss of the true costs by the logarithm of every count."""
    e = materialize(edges_with_cards(t, C.G5), "edges")
    both = costs.with_cost(e, out="est_cost").withColumn("true_cost", col("est_cost"))
    return flow.card_gradients(e, flow.gradients(both, "est_cost", "true_cost"), costs.MODELS[costs.DEFAULT])


@add()
def perturb_errors(t: Tables) -> DataFrame:
    """One count wrong by powers of ten: q-error, plan loss and flow loss of the query."""
    base = materialize(edges_with_cards(t, C.G5), "edges").withColumn("target", F.lit("l o"))
    true = costs.with_cost(base, out="true_cost").select("big", "small", "true_cost")
    varied = costs.with_cost(search.perturbed(base, "target", [10.0**k for k in range(-3, 4)]), out="est_cost")
    both = materialize(varied.join(true, ["big", "small"]), "perturbed")
    flows = flow.flow_loss(flow.flows(both, "est_cost", "true_cost"))
    m = F.element_at(F.split("qid", r"\|"), 3).cast("double")
    found = search.plan_loss(both, "true_cost", "est_cost").join(flows, "qid")
    return found.select(m.alias("m"), F.greatest(m, 1 / m).alias("q_error"), "loss", "ratio", "flow_loss")


@add()
def node_importance(t: Tables) -> DataFrame:
    return flow.node_importance(_flows(t))


@add()
def subset_weights(t: Tables) -> DataFrame:
    subsets = edges.subset_table(t.spark, [C.G5])
    paths = search.simple_paths(edges.drop_one_edges(subsets))
    tolerances = search.tolerance(materialize(edges_with_cards(t, C.G5), "edges"), costs.MODELS[costs.DEFAULT], subsets)
    return flow.weight_schemes(_flows(t), paths, tolerances)


@add(
    "WITH s AS (SELECT card_key, epoch, sum(loss) AS v FROM (SELECT DISTINCT stat_id, card_key, epoch, loss FROM stats WHERE summary_type = 'value' AND loss BETWEEN 0 AND 1000 AND card_key IS NOT NULL) GROUP BY 1, 2),"
    " r AS (SELECT *, sum(v) OVER (PARTITION BY card_key ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM s)"
    " SELECT card_key, epoch, round(x / sum(x) OVER (PARTITION BY epoch), 6) AS weight FROM r"
)
def priority_smoothing(t: Tables) -> DataFrame:
    valid = t.stats.where("summary_type = 'value' AND loss BETWEEN 0 AND 1000 AND card_key IS NOT NULL").select("stat_id", "card_key", "epoch", "loss").distinct()
    sums = valid.groupBy("card_key", "epoch").agg(F.sum("loss").alias("v"))
    return search.recent_priority(sums, ["card_key"], "epoch", "v").select("card_key", "epoch", F.round("weight", 6).alias("weight"))


@add("SELECT p_partkey, round(pow(p_retailprice, 0.5) / sum(pow(p_retailprice, 0.5)) OVER (PARTITION BY p_brand), 8) AS weight FROM part")
def sampling_weights(t: Tables) -> DataFrame:
    return search.sampling_weights(t.part, "p_retailprice", 0.5, ["p_brand"]).select("p_partkey", F.round("weight", 8).alias("weight"))


QUERIES, ORACLES = R.queries, R.oracles
