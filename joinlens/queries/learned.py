"""Features, fitted estimators, generated workloads, sources and the stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlens.operators import features as X
from joinlens.operators import models, replay, stats
from joinlens.plans import edges
from joinlens.queries.base import Registry, Tables
from joinlens.queries.estimates import known
from joinlens.queries.plans import enumerated_sql
from joinlens.queries.results import _GRAPH, _PLANS, _STORED_EDGES, cards, stored_costs, stored_losses
from joinlens.session import materialize, scratch_path
from joinlens.sources import files
from joinlens.sources import qrep as Q
from joinlens.streaming.online_stats import run_available, windowed_stats
from joinlens.workload import catalog as C
from joinlens.workload import generator as G
from joinlens.workload.parser import UnsupportedQuery, parse, split_statements

R = Registry()
add = R.add
col = F.col

# ---- features

_NODES = f"nd AS (SELECT qid, x.id AS alias, x.real_name AS real_name FROM (SELECT qid, unnest(from_json(join_graph, {_GRAPH}).nodes) AS x FROM qrep))"
_LINKS = f"lk AS (SELECT qid, x.source AS a1, x.target AS a2, x.join_condition AS join_condition FROM (SELECT qid, unnest(from_json(join_graph, {_GRAPH}).links) AS x FROM qrep))"


@add(
    f"WITH {_PLANS}, {_NODES}, v AS (SELECT real_name, row_number() OVER (ORDER BY real_name) - 1 AS slot FROM (SELECT DISTINCT real_name FROM nd WHERE real_name IS NOT NULL)),"
    " m AS (SELECT qid, subset, unnest(string_split(subset, ' ')) AS alias FROM cards)"
    " SELECT qid, subset, slot, count(*)::DOUBLE AS value FROM m JOIN nd USING (qid, alias) JOIN v USING (real_name) GROUP BY 1, 2, 3"
)
def table_onehot(t: Tables) -> DataFrame:
    nodes = Q.join_nodes(t.qrep)
    return X.table_onehot(cards(t), nodes, X.vocabulary(nodes, "real_name"))


@add(
    f"WITH {_PLANS}, {_LINKS}, v AS (SELECT join_condition, row_number() OVER (ORDER BY join_condition) - 1 AS slot FROM (SELECT DISTINCT join_condition FROM lk WHERE join_condition IS NOT NULL))"
    " SELECT qid, subset, slot, count(*)::DOUBLE AS value FROM cards JOIN lk USING (qid) JOIN v USING (join_condition)"
    " WHERE list_contains(string_split(subset, ' '), a1) AND list_contains(string_split(subset, ' '), a2) GROUP BY 1, 2, 3"
)
def join_onehot(t: Tables) -> DataFrame:
    joins = Q.join_edges(t.qrep)
    return X.join_onehot(cards(t), joins, X.vocabulary(joins, "join_condition"))


@add(f"WITH RECURSIVE {enumerated_sql(C.G7)} SELECT 'g7' AS qid, array_to_string(s, ' ') AS subset, (SELECT count(*) FROM e WHERE e.small = array_to_string(s, ' ')) AS n_in,"
     " (SELECT count(*) FROM e WHERE e.big = array_to_string(s, ' ')) AS n_out FROM sub")  # fmt: skip
def degree_features(t: Tables) -> DataFrame:
    return X.degree_features(edges.drop_one_edges(edges.subset_table(t.spark, [C.G7])))


@add(
    f"WITH {_PLANS}, k AS (SELECT *, greatest(expected, 1)::DOUBLE AS e FROM cards WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL)"
    " SELECT qid, subset, n_tables, round(ln(e), 6) AS log_est, round(least(1.0, e / greatest(total, 1)), 6) AS est_share, CASE "
    + " ".join(f"WHEN e > {10**i} AND e < {10 ** (i + 1)} THEN {i}" for i in range(10)) + " ELSE 10 END AS bucket FROM k"
)
def estimate_features(t: Tables) -> DataFrame:
    return X.estimate_features(known(t)).withColumns({c: F.round(c, 6) for c in ("log_est", "est_share")})


@add(
    f"WITH {_PLANS}, {_LINKS}, b AS (SELECT qid, a1 AS alias, a2 AS other FROM lk UNION ALL SELECT qid, a2, a1 FROM lk),"
    " m AS (SELECT qid, subset, unnest(string_split(subset, ' ')) AS alias FROM cards),"
    " n AS (SELECT qid, subset, count(DISTINCT other) AS c FROM m JOIN b USING (qid, alias) WHERE NOT list_contains(string_split(subset, ' '), other) GROUP BY 1, 2)"
    " SELECT qid, subset, coalesce(c, 0) AS n_neighbours FROM cards LEFT JOIN n USING (qid, subset)"
)
def neighbour_features(t: Tables) -> DataFrame:
    return X.neighbour_features(cards(t), Q.join_edges(t.qrep))




@add(
    "WITH s AS (SELECT 'p_brand' AS col_name, 'discrete' AS kind, least(10, count(DISTINCT p_brand))::BIGINT AS width FROM part UNION ALL SELECT 'p_size', 'range', 2 FROM part LIMIT 2)"
    ", d AS (SELECT 'p_brand' AS col_name, 'discrete' AS kind, (SELECT least(10, count(DISTINCT p_brand)) FROM part)::BIGINT AS width UNION ALL SELECT 'p_size', 'range', 2)"
    " SELECT col_name, kind, width, coalesce(sum(width) OVER (ORDER BY col_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot FROM d"
)
def feature_layout(t: Tables) -> DataFrame:
    return X.layout(stats.column_stats(t.part, ["p_brand", "p_size"]))


def _filters(t: Tables) -> DataFrame:
    rows = [("a", "p", 0, "p_size", "lt", ["10", "40"]), ("a", "b", 0, "p_brand", "in", ["Brand#2", "Brand#17"]), ("b", "p", 0, "p_size", "lt", [None, "25"]), ("b", "p", 1, "p_brand", "like", ["Brand#1%"])]
    return t.spark.createDataFrame(rows, "qid string, alias string, pos int, col string, op string, vals array<string>")


_BUCKET = "0"
for _at in range(1, 41, 8):
    _BUCKET = f"(({_BUCKET} * {2**32 % 9973} + ('0x' || substr(sha1(v), {_at}, 8))::BIGINT) % 9973)"
_ENDS = "WITH m AS (SELECT min(p_size) AS lo, max(p_size) AS hi, least(10, count(DISTINCT p_brand)) AS w FROM part), "


@add(
    _ENDS + "h AS (SELECT v, ('0x')::VARCHAR AS z FROM (VALUES ('Brand#2'), ('Brand#17')) AS x(v)) SELECT qid, alias, slot::BIGINT AS slot, round(value, 6)::DOUBLE AS value FROM ("
    "SELECT 'a' AS qid, 'p' AS alias, w AS slot, (10 - lo) / (hi - lo) AS value FROM m UNION ALL SELECT 'a', 'p', w + 1, (40 - lo) / (hi - lo) FROM m"
    " UNION ALL SELECT 'b', 'p', w, 0 FROM m UNION ALL SELECT 'b', 'p', w + 1, (25 - lo) / (hi - lo) FROM m"
    f" UNION ALL SELECT DISTINCT 'a', 'b', {_BUCKET} % w, 1 FROM h, m)"
)
def pred_features(t: Tables) -> DataFrame:
    found = materialize(stats.column_stats(t.part, ["p_brand", "p_size"]), "stats")
    return X.predicate_features(_filters(t), X.layout(found), found).withColumn("value", F.round("value", 6))


@add(
    f"WITH {_PLANS}, {_STORED_EDGES}, n AS (SELECT qid, big AS subset, 0 AS i, 1 AS o, 0.0::DOUBLE AS c FROM g UNION ALL SELECT qid, small, 1, 0, ec FROM g), w AS (SELECT qid, sum(ec) AS total FROM g GROUP BY 1)"
    " SELECT qid::VARCHAR AS qid, subset, len(string_split(subset, ' '))::INT AS n_tables, sum(i) AS n_in, sum(o) AS n_out, round(CASE WHEN any_value(total) > 0 THEN sum(c) / any_value(total) ELSE 0 END, 6) AS in_cost"
    " FROM n JOIN w USING (qid) GROUP BY 1, 2"
)
def flow_features(t: Tables) -> DataFrame:
    """Place of every stored sub-plan in its plan graph."""
    return X.flow_features(materialize(stored_costs(t), "costs"), "est_cost").withColumn("in_cost", F.round("in_cost", 6))


@add(
    f"WITH {_PLANS}, k AS (SELECT *, ln(greatest(actual, 1)) AS y FROM cards WHERE actual IS NOT NULL AND expected IS NOT NULL AND total IS NOT NULL), m AS (SELECT min(y) AS lo, max(y) AS hi FROM k WHERE split = 'train')"
    " SELECT qid, subset, round((y - lo) / (hi - lo), 6) AS target, round(least(1.0, actual / greatest(total, 1)), 6) AS selectivity FROM k, m"
)
def model_targets(t: Tables) -> DataFrame:
    """Targets of stored sub-plans: logarithms scaled by those of the training split, and selectivities."""
    plans = known(t)
    y = F.ln(F.greatest(col("actual").cast("double"), F.lit(1.0)))
    lo, hi = plans.where("split = 'train'").agg(F.min(y), F.max(y)).first()
    share = F.least(F.lit(1.0), col("actual") / F.greatest("total", F.lit(1)))
    return plans.select("qid", "subset", F.round(X.log_target(col("actual"), lo, hi), 6).alias("target"), F.round(share, 6).alias("selectivity"))


@add()
def like_pattern_features(t: Tables) -> DataFrame:
    """Hashed grams, length and digits of the patterns of all stored queries."""
    return X.pattern_features(X.workload_filters(t.qrep, "qid", "sql"))


@add(
    "WITH n AS (SELECT qid, lower(sql) AS s FROM qrep WHERE sql IS NOT NULL) SELECT qid,"
    r" len(regexp_extract_all(s, '[a-z0-9_.]\s+like\s')) + len(regexp_extract_all(s, '[a-z0-9_.]\s+ilike\s')) - len(regexp_extract_all(s, '\snot\s+i?like\s')) AS n_like,"
    r" len(regexp_extract_all(s, '\snot\s+i?like\s')) AS n_not_like, len(regexp_extract_all(s, '\snot\s+in\s*\(')) AS n_not_in FROM n"
)
def filter_kinds(t: Tables) -> DataFrame:
    """Filters of the stored texts by kind."""
    kinds = X.workload_filters(t.qrep, "qid", "sql").groupBy("qid").agg(*(F.count_if(col("op") == op).alias(f"n_{op}") for op in ("like", "not_like", "not_in")))
    every = t.qrep.where("sql IS NOT NULL").select("qid").join(kinds, "qid", "left")
    return every.select("qid", *(F.coalesce(f"n_{op}", F.lit(0)).alias(f"n_{op}") for op in ("like", "not_like", "not_in")))


@add()
def operator_features(t: Tables) -> DataFrame:
    return X.operator_features(X.workload_filters(t.qrep, "qid", "sql"))


def _parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Labelled sub-plans, nodes, joins and filters of the stored queries."""
    filters = materialize(X.workload_filters(t.qrep, "qid", "sql"), "filters")
    return known(t), Q.join_nodes(t.qrep), Q.join_edges(t.qrep), filters


@add()
def subset_features(t: Tables) -> DataFrame:
    """Dense vectors of stored sub-plans: tables, joins, kinds of filters, filters, patterns and scalars."""
    return X.dense(*X.combined(*_parts(t)))


# ---- fitted estimators


def _labelled(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Training and test sub-plans with their vectors."""
    plans, *rest = _parts(t)
    vectors = X.dense(*X.combined(plans, *rest))
    rows = materialize(vectors.join(plans.select("qid", "subset", "split", "actual", "expected"), ["qid", "subset"]), "labelled")
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _fitted(kind: str, **options) -> None:
    def run(t: Tables) -> DataFrame:
        train, test = _labelled(t)
        return models.fit_predict(train, test, ["features"], "actual", kind, **options).select("qid", "subset", "actual", "expected", "est")

    add(name={"xgboost": "gbt_estimator", "rf": "rf_estimator", "linear": "linear_estimator"}[kind] + ("_search" if options.get("search") else ""))(run)


_fitted("xgboost")
_fitted("rf")
_fitted("linear", scale="standard")
_fitted("linear", scale="standard", search=True)


def _network(t: Tables, loss: str) -> DataFrame:
    plans, *rest = _parts(t)
    sets, widths = X.set_features(plans, *rest)
    rows = materialize(sets.join(plans.select("qid", "subset", "split", "actual", "expected"), ["qid", "subset"]), "labelled-sets")
    return models.network_predict(rows.where("split = 'train'"), rows.where("split = 'test'"), widths, "actual", ["qid", "subset", "actual", "expected"], loss)


@add()
def network_estimator(t: Tables) -> DataFrame:
    """Sub-plans as sets of tables, joins and filters, squared error of the logarithm."""
    return _network(t, "mse")


@add()
def network_estimator_qloss(t: Tables) -> DataFrame:
    """The same, trained on the q-error."""
    return _network(t, "qloss")


@add()
def cost_ratio_model(t: Tables) -> DataFrame:
    """How much dearer the plan by expected counts is than the best one, predicted from the estimates alone.

    Inputs of a query: mean, least and largest logarithm of estimate over total at each number of tables; target: the ratio of
    the two plans' true costs.
    """
    share = F.ln(F.greatest(col("expected").cast("double"), F.lit(1.0)) / F.greatest(col("total").cast("double"), F.lit(1.0)))
    plans = known(t).withColumn("share", share)
    levels = range(1, 7)
    sums = [F.coalesce(f(F.when(col("n_tables") == n, col("share"))), F.lit(0.0)).alias(f"{name}_{n}") for n in levels for name, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    wide = plans.groupBy("qid", "split").agg(F.max("n_tables").alias("n_tables"), *sums)
    ratio = stored_losses(t).select(col("qid").cast("long").alias("qid"), "ratio").where("ratio IS NOT NULL")
    rows = materialize(wide.join(ratio, "qid"), "cost-ratio")
    inputs = ["n_tables", *(f"{name}_{n}" for n in levels for name in ("mean", "low", "high"))]
    made = models.fit_predict(rows.where("split = 'train'"), rows.where("split = 'test'"), inputs, "ratio", "xgboost")
    return made.select("qid", "ratio", "est")


@add()
def singular_energy(t: Tables) -> DataFrame:
    """Singular values, for every template, of its sub-plan by query matrix of log counts."""
    key = F.nullif(F.regexp_replace(F.lower("template_name"), "[^a-z0-9]", ""), F.lit(""))
    logs = known(t).select(key.alias("template"), "subset", "qid", F.ln(F.greatest("actual", F.lit(1))).alias("x")).where("template IS NOT NULL")
    return models.singular_energy(logs, "template", "qid", "subset", "x")


# ---- workloads


def _extracted(t: Tables) -> DataFrame:
    """(qid, pos, col, op, n_values) of every filter in the stored query texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for qid, sql in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    preds = parse(sql).preds if sql else []
                except UnsupportedQuery:
                    preds = [{"column": "", "op": "unsupported", "values": []}]
                for pos, p in enumerate(preds):
                    for into, x in zip(out, (qid, pos, p["column"], p["op"], len(p["values"])), strict=True):
                        into.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int32())], ["qid", "pos", "col", "op", "n_values"])

    return t.qrep.select("qid", "sql").mapInArrow(run, "qid long, pos int, col string, op string, n_values int")


@add(
    r"SELECT qid, len(regexp_extract_all(lower(sql), ' in\s*\(')) - len(regexp_extract_all(lower(sql), ' not\s+in\s*\(')) + len(regexp_extract_all(lower(sql), 'is\s+null')) AS n_in, len(regexp_extract_all(lower(sql), 'i?like\s+')) AS n_like FROM qrep WHERE sql IS NOT NULL"
)
def extracted_predicates(t: Tables) -> DataFrame:
    found = _extracted(t)
    return found.groupBy("qid").agg(F.count_if(col("op") == "in").alias("n_in"), F.count_if(col("op").isin("like", "not_like")).alias("n_like"))


@add()
def workload_profile(t: Tables) -> DataFrame:
    return G.profile(_extracted(t))


@add("SELECT template, sql_key, row_number() OVER (PARTITION BY template ORDER BY sql_key) AS number FROM (SELECT DISTINCT ON (sql_key) sql_key, n_tables::VARCHAR AS template FROM qrep) AS q"
     " WHERE sql_key IN (SELECT sql_key FROM runtimes WHERE runtime IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE runtime >= 909) <= 10)")  # fmt: skip
def curated_workload(t: Tables) -> DataFrame:
    queries = t.qrep.groupBy("sql_key").agg(F.min("n_tables").cast("string").alias("template"))
    return G.curate(queries, t.runtimes).select("template", "sql_key", "number")


TEMPLATE = """
title = "parts"
[base_sql]
sql = "SELECT COUNT(*) FROM part AS p, lineitem AS l WHERE p.p_partkey = l.l_partkey AND BRANDS AND SIZES AND NAMES"
[[templates]]
name = "a"
[[templates.predicates]]
type = "sql"
columns = ["p.p_brand"]
keys = ["BRANDS"]
sql = "SELECT p_brand, COUNT(*) FROM part GROUP BY p_brand"
pred_type = "in"
sampling_method = "quantile"
num_quantiles = 2
min_samples = 1
max_samples = 3
[[templates.predicates]]
type = "list"
columns = ["p.p_size"]
keys = ["SIZES"]
options = [[1, 10], [5, 30]]
pred_type = "range"
[[templates.predicates]]
type = "sql"
columns = ["p.p_name"]
keys = ["NAMES"]
dependencies = 1
sql = "SELECT p_name, COUNT(*) FROM part AS p WHERE BRANDS GROUP BY p_name"
pred_type = "ILIKE"
min_chars = 3
max_chars = 4
min_count = 2
"""


@add()
def workload_generate(t: Tables) -> DataFrame:
    spark = t.views("part", "lineitem")
    made = G.generate(spark, TEMPLATE, 12, seed=1)
    return spark.createDataFrame([(i, q) for i, q in enumerate(made)], "qid int, sql string")


@add()
def workload_quotas(t: Tables) -> DataFrame:
    """Two templates with a quota each."""
    spark = t.views("part", "lineitem")
    other = TEMPLATE.replace("num_quantiles = 2", "num_quantiles = 4")
    return spark.createDataFrame(G.generate_all(spark, {"a": TEMPLATE, "b": other}, {"a": 3}, default=5), "template string, number int, sql string")


@add("SELECT * FROM (VALUES (0, 'SELECT COUNT(*) FROM a'), (1, 'select min(x) from b')) AS x(pos, sql)")
def split_script(t: Tables) -> DataFrame:
    found = split_statements("use imdb; SELECT COUNT(*) FROM a;\nSET x = 1;\nselect min(x) from b;")
    return t.spark.createDataFrame(list(enumerate(found)), "pos int, sql string")


# ---- sources and sinks


@add("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.customer.select(col("c_custkey").alias("C Custkey"), col("c_mktsegment").alias("C Mktsegment"), col("c_acctbal").alias("C Acctbal")).write.csv(path, header=True, sep="|")
    return files.read_delimited(t.spark, path, "|")


@add("SELECT o_orderkey AS c0, o_custkey AS c1, 1::BIGINT AS c2, 2::BIGINT AS d0, 3::BIGINT AS d1 FROM orders")
def binary_load(t: Tables) -> DataFrame:
    """Orders as fixed-length records, written by the workers and read back in splits."""
    path = scratch_path(t.spark, "binary")
    table = t.orders.select("o_orderkey", "o_custkey")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<6q", 0, a, b, 1, 2, 3) for a, b in rows], pa.binary())], ["r"])

    records = table.mapInArrow(pack, "r binary")
    _write_binary(records, path)
    return files.read_int64_records(t.spark, path)


def _write_binary(records: DataFrame, path: str) -> None:
    """Files of concatenated records, a few at a time, in whatever store the path names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base)
        n = 0
        with store.open_output_stream(f"{base}/part-{uuid.uuid4().hex}.bin") as out:
            for batch in batches:
                out.write(b"".join(x.as_py() for x in batch.column(0)))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    records.coalesce(4).mapInArrow(run, "n long").agg(F.sum("n")).collect()


@add()
def gaussian_table(t: Tables) -> DataFrame:
    return files.gaussian_table(t.spark, 1000, 4, seed=3)


@add("SELECT sql_key, array_to_string(list_sort(list(DISTINCT template_name)), '|') AS texts FROM qrep WHERE template_name IS NOT NULL GROUP BY 1")
def merged_caches(t: Tables) -> DataFrame:
    kept = t.qrep.where("template_name IS NOT NULL").select("sql_key", "template_name")
    halves = [kept.where(F.col("template_name") < "5"), kept.where(F.col("template_name") >= "5")]
    return files.merge_caches(halves, "sql_key", "template_name").select("sql_key", F.array_join("texts", "|").alias("texts"))


@add("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def streaming_event_stats(t: Tables) -> DataFrame:
    """The stream of events run until it has caught up; nothing is late within one pass over the table."""
    source = f"{t.sf_dir}/events.parquet*"  # a file or a folder of files
    found = run_available(t.spark, source, t.events.schema, lambda df: windowed_stats(df, "ts", "event_type", "value"), ["start", "event_type"])
    return found.select("event_type", col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "low", "high")


@add()
def runtime_replay(t: Tables) -> DataFrame:
    """Runtimes of two queries, each three times from a cold cache; a third is known and skipped."""
    spark = t.views("orders", "customer", "lineitem", "nation", "part")
    texts = [(q.qid, q.count_sql()) for q in (C.G3, C.G5)] + [("known", "SELECT COUNT(*) FROM nation")]
    queries = spark.createDataFrame(texts, "sql_key string, sql string")
    return replay.replay(spark, queries, spark.createDataFrame([("known",)], "sql_key string"), repetitions=3, timeout_ms=900_000)


@add()
def plan_tree(t: Tables) -> DataFrame:
    """Operators of the optimized plan of a query."""
    return stats.plan_nodes(t.views("orders", "customer", "lineitem"), C.G3.count_sql())


QUERIES, ORACLES = R.queries, R.oracles
