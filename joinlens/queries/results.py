"""Stored workloads, q-error tables and result analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators import metrics, setops
from joinlens.operators.percentiles import exact_percentiles
from joinlens.plans import costs, edges, search
from joinlens.queries.base import Registry, Tables
from joinlens.session import materialize
from joinlens.sources import qrep as Q

R = Registry()
add = R.add
col = F.col

_JSON = "'{\"nodes\": [{\"id\": [\"VARCHAR\"], \"cardinality\": {\"actual\": \"BIGINT\", \"expected\": \"BIGINT\", \"total\": \"BIGINT\"}}], \"adjacency\": [[{\"id\": [\"VARCHAR\"]}]]}'"
_PLANS = f"""n0 AS (SELECT qid, split, template_name, unnest(from_json(subset_graph, {_JSON}).nodes) AS x FROM qrep WHERE subset_graph IS NOT NULL),
n1 AS (SELECT qid, split, template_name, array_to_string(list_sort(x.id), ' ') AS subset, len(x.id)::INT AS n_tables, x.cardinality.actual AS raw,
       x.cardinality.expected AS expected, x.cardinality.total AS total FROM n0),
cards AS (SELECT *, CASE WHEN raw IS NULL THEN 'missing' WHEN raw IN (150001000000, 150001000) THEN 'cross_join' WHEN raw IN (150001000001, 150001001) THEN 'timeout'
          WHEN raw IN (150001000002, 150001002) THEN 'exception' ELSE 'ok' END AS status,
          CASE WHEN raw NOT IN (150001000000, 150001000001, 150001000002, 150001000, 150001001, 150001002) THEN raw END AS actual FROM n1)"""
_ERRORS = f"""{_PLANS}, whole AS (SELECT qid FROM cards GROUP BY 1 HAVING count(*) = count(CASE WHEN actual IS NOT NULL AND expected IS NOT NULL THEN 1 END)),
e0 AS (SELECT cards.*, greatest(actual, 1)::DOUBLE AS y, greatest(expected, 1)::DOUBLE AS p FROM cards JOIN whole USING (qid)),
errors AS (SELECT *, CASE WHEN y > p THEN -(y / p) ELSE p / y END AS signed_q, greatest(y / p, p / y) AS q FROM e0)"""


def cards(t: Tables) -> DataFrame:
    return Q.sub_plans(t.qrep, ["split", "template_name"])


def errors(t: Tables) -> DataFrame:
    return metrics.subset_qerrors(materialize(cards(t), "cards"))


@add(f"WITH {_PLANS} SELECT qid, subset, n_tables, actual, expected, total, status FROM cards")
def stored_sub_plans(t: Tables) -> DataFrame:
    return cards(t).drop("split", "template_name")


@add(f"WITH {_PLANS} SELECT status, count(*) AS n FROM cards GROUP BY 1")
def status_audit(t: Tables) -> DataFrame:
    return cards(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@add(
    f"""WITH g AS (SELECT qid, from_json(subset_graph, {_JSON}) AS g FROM qrep WHERE subset_graph IS NOT NULL),
x AS (SELECT qid, unnest(list_zip(list_transform(g.nodes, lambda n: n.id), g.adjacency)) AS z FROM g),
y AS (SELECT qid, list_sort(z[1]) AS big, unnest(z[2]) AS s FROM x)
SELECT qid, array_to_string(big, ' ') AS big, array_to_string(list_sort(s.id), ' ') AS small, array_to_string(list_filter(big, lambda a: NOT list_contains(s.id, a)), ' ') AS other FROM y"""
)
def stored_plan_edges(t: Tables) -> DataFrame:
    return Q.plan_edges(t.qrep)


@add(f"SELECT qid, count(x.cardinality.total) AS n, sum(x.cardinality.total)::BIGINT AS total FROM (SELECT qid, unnest(from_json(subset_graph, {_JSON}).nodes) AS x FROM qrep WHERE subset_graph IS NOT NULL) GROUP BY 1")
def json_key_values(t: Tables) -> DataFrame:
    values = Q.json_values(t.qrep, "qid", "subset_graph", "total").withColumn("value", F.nullif("value", F.lit("null")).cast("long"))
    return values.groupBy("qid").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@add("SELECT n_tables, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM qrep GROUP BY 1")
def split_matrix(t: Tables) -> DataFrame:
    made = t.qrep.groupBy("n_tables").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1)))
    return made.select("n_tables", *(F.coalesce(col(c), F.lit(0)).alias(c) for c in ("train", "val", "test")))


_GRAPH = "'{\"nodes\": [{\"id\": \"VARCHAR\", \"real_name\": \"VARCHAR\", \"pred_cols\": [\"VARCHAR\"]}], \"links\": [{\"source\": \"VARCHAR\", \"target\": \"VARCHAR\", \"join_condition\": \"VARCHAR\"}]}'"


@add(f"SELECT real_name, count(*) AS n, sum(len(pred_cols))::BIGINT AS n_preds FROM (SELECT x.real_name AS real_name, x.pred_cols AS pred_cols FROM (SELECT unnest(from_json(join_graph, {_GRAPH}).nodes) AS x FROM qrep)) GROUP BY 1")
def workload_tables(t: Tables) -> DataFrame:
    return Q.join_nodes(t.qrep).groupBy("real_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("pred_cols")).alias("n_preds"))


@add(f"SELECT a1, a2, join_condition, count(*) AS n FROM (SELECT x.source AS a1, x.target AS a2, x.join_condition AS join_condition FROM (SELECT unnest(from_json(join_graph, {_GRAPH}).links) AS x FROM qrep)) GROUP BY ALL")
def workload_joins(t: Tables) -> DataFrame:
    return Q.join_edges(t.qrep).groupBy("a1", "a2", "join_condition").agg(F.count(F.lit(1)).alias("n"))


@add(f"WITH {_ERRORS} SELECT qid, subset, round(signed_q, 6) AS signed_q, round(q, 6) AS q FROM errors")
def qerror_by_subset(t: Tables) -> DataFrame:
    return errors(t).select("qid", "subset", F.round("signed_q", 6).alias("signed_q"), F.round("q", 6).alias("q"))


@add(
    f"WITH {_ERRORS} SELECT qid, round(avg(q), 6) AS mean_q, round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.9), 6) AS p90,"
    " round(quantile_cont(q, 0.95), 6) AS p95, round(quantile_cont(q, 0.99), 6) AS p99 FROM errors GROUP BY 1"
)
def qerror_by_query(t: Tables) -> DataFrame:
    made = metrics.per_query(materialize(errors(t), "errors"))
    return made.select("qid", *(F.round(c, 6).alias(c) for c in ("mean_q", "p50", "p90", "p95", "p99")))


@add(f"WITH {_ERRORS}, top AS (SELECT qid, max(n_tables) AS m FROM errors GROUP BY 1) SELECT qid, subset, round(q, 6) AS q FROM errors JOIN top USING (qid) WHERE n_tables = m")
def qerror_full_query(t: Tables) -> DataFrame:
    return metrics.full_queries(materialize(errors(t), "errors")).select("qid", "subset", F.round("q", 6).alias("q"))


@add(f"WITH {_ERRORS} SELECT qid, sha1(sql || subset) AS subq_hash, round(signed_q, 6) AS loss FROM errors JOIN (SELECT qid, sql FROM qrep) USING (qid) WHERE sql IS NOT NULL")
def subset_error_hash(t: Tables) -> DataFrame:
    """Sub-plans known by the text of their query."""
    texts = t.qrep.where("sql IS NOT NULL").select("qid", "sql")
    return errors(t).join(texts, "qid").select("qid", F.sha1(F.concat("sql", "subset").cast("binary")).alias("subq_hash"), F.round("signed_q", 6).alias("loss"))


_Q = "round(quantile_cont(q, {}), 6)"


@add(
    f"WITH {_ERRORS} SELECT coalesce(CASE WHEN grouping(split) = 0 THEN split ELSE 'all' END, NULL) AS split, CASE WHEN grouping(n_tables) = 0 THEN n_tables::VARCHAR ELSE 'all' END AS n_tables,"
    " count(*) AS num_samples, unnest(['mean', 'max', 'min', 'percentile:25', 'percentile:50', 'percentile:75', 'percentile:90', 'percentile:99']) AS summary_type,"
    f" unnest([round(avg(q), 6), round(max(q), 6), round(min(q), 6), {', '.join(_Q.format(x) for x in (0.25, 0.5, 0.75, 0.9, 0.99))}]) AS loss FROM errors GROUP BY CUBE (split, n_tables)"
)
def cube_summary(t: Tables) -> DataFrame:
    return metrics.cube_summary(materialize(errors(t), "errors"), "q", "split", "n_tables").withColumn("loss", F.round("loss", 6))


@add(
    f"WITH {_ERRORS} SELECT n_tables, count(*) FILTER (WHERE signed_q >= 0) AS n_over, count(*) FILTER (WHERE signed_q < 0) AS n_under,"
    " round(avg(q) FILTER (WHERE signed_q >= 0), 6) AS mean_over, round(avg(q) FILTER (WHERE signed_q < 0), 6) AS mean_under FROM errors GROUP BY 1"
)
def over_under(t: Tables) -> DataFrame:
    made = metrics.over_under(errors(t), ["n_tables"])
    return made.withColumns({c: F.round(c, 6) for c in ("mean_over", "mean_under")})


@add(
    f"WITH {_ERRORS}, c AS (SELECT quantile_cont(q, 0.2) AS lo, quantile_cont(q, 0.8) AS hi FROM errors)"
    " SELECT CASE WHEN q >= hi THEN 'high' WHEN q <= lo THEN 'low' ELSE 'mid' END AS band, count(*) AS n, round(avg(q), 6) AS mean_q FROM errors, c GROUP BY 1"
)
def importance_bands(t: Tables) -> DataFrame:
    from joinlens.operators.windows import quantile_bands

    return quantile_bands(materialize(errors(t), "errors"), "q", "band").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("mean_q"))


_VALUES = "SELECT DISTINCT stat_id, template, samples_type, loss_type, loss FROM stats WHERE summary_type = 'value' AND loss IS NOT NULL AND NOT isnan(loss) AND NOT isinf(loss)"


def _values(t: Tables) -> DataFrame:
    valid = t.stats.where("summary_type = 'value' AND loss IS NOT NULL AND NOT isnan(loss) AND abs(loss) <> double('inf')")
    return valid.select("stat_id", "template", "samples_type", "loss_type", "loss").distinct()


@add(
    f"SELECT samples_type, loss_type, count(*) AS n, round(quantile_cont(loss, 0.5), 4) AS p50, round(quantile_cont(loss, 0.95), 4) AS p95, round(quantile_cont(loss, 0.99), 4) AS p99 FROM ({_VALUES}) GROUP BY 1, 2"
)
def loss_report(t: Tables) -> DataFrame:
    made = exact_percentiles(_values(t), ["samples_type", "loss_type"], "loss", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return made.withColumns({c: F.round(c, 4) for c in ("p50", "p95", "p99")})


@add("SELECT DISTINCT r.sql_key, m.mean_runtime, m.n_runs, q.n_tables FROM (SELECT sql_key, round(avg(runtime), 6) AS mean_runtime, count(*) AS n_runs FROM (SELECT DISTINCT * FROM runtimes WHERE runtime < 909 AND NOT isnan(runtime)) GROUP BY 1) AS m JOIN qrep AS q USING (sql_key) JOIN runtimes AS r USING (sql_key)")
def runtime_vs_query(t: Tables) -> DataFrame:
    keys = t.qrep.select("sql_key", "n_tables").distinct()
    return metrics.runtime_table(t.runtimes, keys, "sql_key").select("sql_key", F.round("mean_runtime", 6).alias("mean_runtime"), "n_runs", "n_tables")


@add("SELECT q.sql_key FROM (SELECT DISTINCT sql_key FROM qrep) AS q WHERE NOT EXISTS (SELECT 1 FROM runtimes AS r WHERE r.sql_key = q.sql_key)")
def replay_todo(t: Tables) -> DataFrame:
    """Queries still to be run: those without any stored runtime."""
    return t.qrep.select("sql_key").distinct().join(t.runtimes.select("sql_key"), "sql_key", "left_anti")


@add(
    "SELECT stat_id, CASE WHEN loss_type = 'qerr' AND num_tables = '1' THEN 'single' WHEN loss_type = 'qerr' THEN 'join' WHEN loss_type = 'abs' THEN 'absolute' END AS label"
    " FROM stats WHERE summary_type = 'mean' AND loss_type IN ('qerr', 'abs')"
)
def ablation_label(t: Tables) -> DataFrame:
    rules = [((col("loss_type") == "qerr") & (col("num_tables") == "1"), "single"), (col("loss_type") == "qerr", "join"), (col("loss_type") == "abs", "absolute")]
    labelled = t.stats.where("summary_type = 'mean'").withColumn("label", metrics.ordered_label(rules))
    return labelled.where("label <> 'Unknown'").select("stat_id", "label")


@add(f"SELECT template, round(avg(loss), 3) AS mean_loss FROM ({_VALUES}) WHERE loss_type NOT LIKE '%gradient%' AND loss BETWEEN 0 AND 1000000 GROUP BY 1")
def template_ranking(t: Tables) -> DataFrame:
    kept = _values(t).where(~col("loss_type").contains("gradient") & col("loss").between(0, 1000000))
    return kept.groupBy("template").agg(F.round(F.avg("loss"), 3).alias("mean_loss"))


@add("SELECT concat_ws('_', loss_type, samples_type, summary_type) AS label, count(*) AS n FROM stats GROUP BY 1")
def composite_label(t: Tables) -> DataFrame:
    return t.stats.groupBy(F.concat_ws("_", "loss_type", "samples_type", "summary_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@add(
    f"WITH {_PLANS} SELECT n_tables, count(*) AS n, round(avg(ln(actual)), 6) AS mean_log_true, round(avg(ln(expected)), 6) AS mean_log_est FROM cards"
    " WHERE actual > 0 AND actual <= 50000000 AND expected > 0 GROUP BY 1"
)
def size_profile(t: Tables) -> DataFrame:
    made = metrics.base_table_profile(cards(t))
    return made.withColumns({c: F.round(c, 6) for c in ("mean_log_true", "mean_log_est")})


@add(f"WITH {_PLANS} SELECT qid, subset, actual, greatest(actual, total) AS total, round(CASE WHEN greatest(actual, total) > 0 THEN actual / greatest(actual, total) END, 6) AS selectivity FROM cards WHERE actual IS NOT NULL AND total IS NOT NULL")
def clipped_selectivity(t: Tables) -> DataFrame:
    from joinlens.operators.cards import clip_to_total

    kept = cards(t).where("actual IS NOT NULL AND total IS NOT NULL").select("qid", "subset", "actual", "total")
    return clip_to_total(kept).withColumn("selectivity", F.round("selectivity", 6))


@add("SELECT count(DISTINCT CASE WHEN split = 'test' THEN sql_key END) AS n_a, count(DISTINCT CASE WHEN split = 'train' THEN sql_key END) AS n_b, (SELECT count(*) FROM (SELECT sql_key FROM qrep WHERE split = 'test' INTERSECT SELECT sql_key FROM qrep WHERE split = 'train')) AS n_both, round((SELECT count(*) FROM (SELECT sql_key FROM qrep WHERE split = 'test' INTERSECT SELECT sql_key FROM qrep WHERE split = 'train')) / count(DISTINCT CASE WHEN split = 'test' THEN sql_key END), 6) AS ratio FROM qrep")
def overlap_ratio(t: Tables) -> DataFrame:
    return setops.id_overlap_ratio(t.qrep.where("split = 'test'"), t.qrep.where("split = 'train'"), "sql_key")


_STORED_EDGES = f"""g9 AS (SELECT qid, from_json(subset_graph, {_JSON}) AS g FROM qrep WHERE subset_graph IS NOT NULL),
x9 AS (SELECT qid, unnest(list_zip(list_transform(g.nodes, lambda n: n.id), g.adjacency)) AS z FROM g9),
y9 AS (SELECT qid, list_sort(z[1]) AS big, unnest(z[2]) AS s FROM x9),
e9 AS (SELECT qid, array_to_string(big, ' ') AS big, array_to_string(list_sort(s.id), ' ') AS small, array_to_string(list_filter(big, lambda a: NOT list_contains(s.id, a)), ' ') AS other FROM y9),
k9 AS (SELECT qid, subset, greatest(actual, 1)::DOUBLE AS a, greatest(expected, 1)::DOUBLE AS p FROM cards WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL),
v9 AS (SELECT e9.*, x.a AS c1, y.a AS c2, x.p AS k1, y.p AS k2, small NOT LIKE '% %' AS one FROM e9 JOIN k9 AS x ON x.qid = e9.qid AND x.subset = small
       JOIN k9 AS y ON y.qid = e9.qid AND y.subset = other JOIN k9 AS z ON z.qid = e9.qid AND z.subset = big),
g AS (SELECT *, least(CASE WHEN one THEN c2 + 0.001 * c1 ELSE c1 + 0.001 * c2 END, c1 * c2) AS tc, least(CASE WHEN one THEN k2 + 0.001 * k1 ELSE k1 + 0.001 * k2 END, k1 * k2) AS ec FROM v9)"""


def _stored_loss_sql() -> str:
    from joinlens.queries.plans import dp_keyed_sql

    return (
        f"WITH {_PLANS}, {_STORED_EDGES}, {dp_keyed_sql('g', 'w', 'qid', 'ec', 'tc', 8)}, {dp_keyed_sql('g', 'd', 'qid', 'tc', '0', 8)},"
        " top AS (SELECT qid, max(n) AS n FROM d GROUP BY 1)"
        " SELECT d.qid::VARCHAR AS qid, round(w.carried, 4) AS est_plan_cost, round(d.best, 4) AS best_cost, round(greatest(w.carried - d.best, 0), 4) AS loss, round(CASE WHEN d.best <> 0 THEN w.carried / d.best END, 6) AS ratio"
        " FROM d JOIN top ON top.qid = d.qid AND top.n = d.n JOIN w ON w.qid = d.qid AND w.subset = d.subset"
    )


@add(_stored_loss_sql())
def stored_plan_loss(t: Tables) -> DataFrame:
    """Plan loss of every stored query by its expected counts, all queries in one stage."""
    return stored_losses(t).select("qid", *(F.round(c, 4).alias(c) for c in ("est_plan_cost", "best_cost", "loss")), F.round("ratio", 6).alias("ratio"))


def stored_costs(t: Tables) -> DataFrame:
    """Stored plan edges with their costs by true and by expected counts."""
    known = materialize(cards(t).where("actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL").withColumn("qid", col("qid").cast("string")), "cards")
    stored = Q.plan_edges(t.qrep).withColumn("qid", col("qid").cast("string"))
    return costs.with_both_costs(edges.with_cards(stored, known, "actual", "total", "expected"))


def stored_losses(t: Tables) -> DataFrame:
    return search.plan_loss(stored_costs(t), "true_cost", "est_cost")


_LOSSES = f"""{_PLANS}, {_STORED_EDGES}"""


def _weights_sql() -> str:
    from joinlens.queries.plans import dp_keyed_sql

    return (
        f"WITH {_LOSSES}, {dp_keyed_sql('g', 'w', 'qid', 'ec', 'tc', 8)}, {dp_keyed_sql('g', 'd', 'qid', 'tc', '0', 8)}, top AS (SELECT qid, max(n) AS n FROM d GROUP BY 1),"
        " lo AS (SELECT d.qid, greatest(w.carried - d.best, 0) AS loss FROM d JOIN top ON top.qid = d.qid AND top.n = d.n JOIN w ON w.qid = d.qid AND w.subset = d.subset)"
    )


@add(_weights_sql() + ", c AS (SELECT qid, subset, count(*) OVER (PARTITION BY qid) AS n FROM cards) SELECT c.qid, subset, round(loss / 1000000 / n, 8) AS weight FROM c JOIN lo USING (qid)")
def query_level_weights(t: Tables) -> DataFrame:
    """Every sub-plan weighted by its query's plan loss, shared among the query's sub-plans."""
    losses = stored_losses(t).select(col("qid").cast("long").alias("qid"), "loss", "ratio")
    return search.query_weights(losses, cards(t).select("qid", "subset"), "loss", True).select("qid", "subset", F.round("weight", 8).alias("weight"))


@add()
def subquery_priorities(t: Tables) -> DataFrame:
    """Sub-plans blamed for the plan loss of their query."""
    return search.subquery_priorities(stored_costs(t), "true_cost", "est_cost")


@add(
    _weights_sql() + ", r AS (SELECT sql_key, avg(runtime) AS runtime FROM (SELECT DISTINCT sql_key, runtime, ran_at FROM runtimes WHERE runtime IS NOT NULL AND NOT isnan(runtime)) GROUP BY 1),"
    " k AS (SELECT q.sql_key, max(loss) AS loss FROM lo JOIN qrep AS q ON q.qid = lo.qid GROUP BY 1)"
    " SELECT CASE WHEN loss < 0.0001 THEN -1 ELSE floor(log10(loss))::INT END AS magnitude, count(*) AS n, round(avg(runtime), 4) AS mean_runtime FROM k JOIN r USING (sql_key) GROUP BY 1"
)
def priority_vs_runtime(t: Tables) -> DataFrame:
    """Mean runtime of queries by the order of magnitude of their plan loss."""
    losses = stored_losses(t).select(col("qid").cast("long").alias("qid"), "loss").join(t.qrep.select("qid", "sql_key"), "qid").groupBy("sql_key").agg(F.max("loss").alias("loss"))
    runs = t.runtimes.where("runtime IS NOT NULL AND NOT isnan(runtime)").select("sql_key", "runtime", "ran_at").distinct().groupBy("sql_key").agg(F.avg("runtime").alias("runtime"))
    magnitude = F.when(col("loss") < 0.0001, -1).otherwise(F.floor(F.log10("loss"))).cast("int")
    return losses.join(runs, "sql_key").groupBy(magnitude.alias("magnitude")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("runtime"), 4).alias("mean_runtime"))


@add(
    "WITH v AS (SELECT DISTINCT stat_id, samples_type, loss_type, loss FROM stats WHERE summary_type = 'value' AND loss BETWEEN 0 AND 1000000)"
    " SELECT 0 AS experiment, 'qerr' AS loss_type, NULL AS scaled, samples_type, count(*) AS n, round(avg(loss), 4) AS mean FROM v WHERE loss_type = 'qerr' GROUP BY samples_type"
    " UNION ALL SELECT 1, 'rel', 'True', samples_type, count(*), round(avg(loss), 4) FROM v WHERE loss_type = 'rel' GROUP BY samples_type"
)
def experiment_table(t: Tables) -> DataFrame:
    """Summaries of two runs with their settings."""
    values = t.stats.where("summary_type = 'value' AND loss BETWEEN 0 AND 1000000").select("stat_id", "samples_type", "loss_type", "loss").distinct()

    def run(kind: str) -> DataFrame:
        return values.where(col("loss_type") == kind).groupBy("samples_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 4).alias("mean"))

    return setops.experiment_table([(run("qerr"), {"loss_type": "qerr"}), (run("rel"), {"loss_type": "rel", "scaled": True})])


@add(
    f"WITH {_PLANS}, s AS (SELECT n_tables, least(1.0, actual / total) AS s FROM cards WHERE actual IS NOT NULL AND total > 0)"
    " SELECT n_tables, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50,"
    " round(quantile_cont(s, 0.75), 6) AS p75, round(max(s), 6) AS most FROM s GROUP BY 1"
)
def selectivity_profile(t: Tables) -> DataFrame:
    """Selectivities of the stored sub-plans by number of tables."""
    rows = materialize(cards(t).where("actual IS NOT NULL AND total > 0").select("n_tables", F.least(F.lit(1.0), col("actual") / col("total")).alias("s")), "selectivity")
    sums = rows.groupBy("n_tables").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.min("s"), 6).alias("least"), F.round(F.max("s"), 6).alias("most"))
    found = exact_percentiles(rows, ["n_tables"], "s", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return found.join(sums, "n_tables").select("n_tables", "n", "mean", "least", *(F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")), "most")


@add(f"WITH {_PLANS} SELECT qid, subset, row_number() OVER (PARTITION BY qid ORDER BY n_tables DESC, subset) AS place FROM cards")
def subsets_largest_first(t: Tables) -> DataFrame:
    """The order in which sub-plans are counted: the largest of a query first."""
    from pyspark.sql import Window

    within = Window.partitionBy("qid").orderBy(F.desc("n_tables"), "subset")  # the sub-plans of one query
    return cards(t).select("qid", "subset", F.row_number().over(within).alias("place"))


@add("SELECT qid, replace(sql, '''', '') AS sql FROM qrep WHERE sql IS NOT NULL")
def unquoted_texts(t: Tables) -> DataFrame:
    from joinlens.functions.scalars import strip_quotes

    return t.qrep.where("sql IS NOT NULL").select("qid", strip_quotes(col("sql")).alias("sql"))


QUERIES, ORACLES = R.queries, R.oracles
