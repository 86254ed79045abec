"""The SQL dialect of the query corpora: predicates, joins, aggregates, windows, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinlens.functions import scalars as S
from joinlens.operators import setops, windows
from joinlens.operators.percentiles import exact_percentiles
from joinlens.queries.base import Registry, Tables
from joinlens.sources import qrep as Q

R = Registry()
add = R.add
col = F.col


def rows() -> Column:
    return F.count(F.lit(1)).alias("n")

# ---- projections, filters, predicates


@add("SELECT count(*) AS n FROM lineitem")
def count_star(t: Tables) -> DataFrame:
    return t.lineitem.agg(rows())


@add("SELECT min(p_name) AS first_name, min(l_shipdate) AS first_ship FROM part, lineitem WHERE p_partkey = l_partkey AND p_size = 15")
def min_over_join(t: Tables) -> DataFrame:
    return t.part.where("p_size = 15").join(t.lineitem, col("p_partkey") == col("l_partkey")).agg(F.min("p_name").alias("first_name"), F.min("l_shipdate").alias("first_ship"))


@add("SELECT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 9000")
def project_columns(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9000").select("c_mktsegment", "c_nationkey")


@add("SELECT count(*) AS n FROM info_type WHERE id = '3'")
def eq_text_literal(t: Tables) -> DataFrame:
    return t.info_type.where("id = '3'").agg(rows())


@add("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')")
def in_list(t: Tables) -> DataFrame:
    return t.orders.where(col("o_orderstatus").isin("F", "P")).agg(rows())


@add("SELECT count(*) AS n FROM title WHERE production_year IN (1990, 2001) OR production_year IS NULL")
def in_or_null(t: Tables) -> DataFrame:
    return t.title.where(col("production_year").isin(1990, 2001) | col("production_year").isNull()).agg(rows())


@add("SELECT count(*) AS n FROM part WHERE 10 < p_size AND p_size <= 30")
def range_half_open(t: Tables) -> DataFrame:
    return t.part.where("10 < p_size AND p_size <= 30").agg(rows())


@add("SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
def range_closed(t: Tables) -> DataFrame:
    return t.lineitem.where(col("l_quantity").between(10, 20)).agg(rows())


@add("SELECT count(*) AS n FROM nation WHERE n_name BETWEEN 'NATION_1' AND 'NATION_2'")
def between_str(t: Tables) -> DataFrame:
    return t.nation.where(col("n_name").between("NATION_1", "NATION_2")).agg(rows())


@add("SELECT count(*) AS n FROM documents WHERE text LIKE '%estimate%rows%'")
def like_multi(t: Tables) -> DataFrame:
    return t.documents.where(col("text").like("%estimate%rows%")).agg(rows())


@add("SELECT count(*) AS n FROM movie_info WHERE note NOT LIKE '%a%'")
def not_like(t: Tables) -> DataFrame:
    return t.movie_info.where(~col("note").like("%a%")).agg(rows())


@add("SELECT count(*) AS n FROM documents WHERE text ILIKE '%JOIN%'")
def ilike(t: Tables) -> DataFrame:
    return t.documents.where(col("text").ilike("%JOIN%")).agg(rows())


@add("SELECT count(*) AS n FROM customer WHERE c_mktsegment != 'BUILDING'")
def not_equal(t: Tables) -> DataFrame:
    return t.customer.where("c_mktsegment != 'BUILDING'").agg(rows())


@add("SELECT count(*) AS n, count(*) FILTER (WHERE production_year IS NULL) AS n_null, count(*) FILTER (WHERE episode_nr IS NOT NULL) AS n_episode FROM title")
def null_tests(t: Tables) -> DataFrame:
    return t.title.agg(rows(), F.count_if(col("production_year").isNull()).alias("n_null"), F.count_if(col("episode_nr").isNotNull()).alias("n_episode"))


@add("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR (o_orderpriority LIKE '1%' AND (o_totalprice > 200000 OR o_custkey < 100))")
def or_nested(t: Tables) -> DataFrame:
    urgent = col("o_orderpriority").like("1%") & ((col("o_totalprice") > 200000) | (col("o_custkey") < 100))
    return t.orders.where((col("o_orderstatus") == "F") | urgent).agg(rows())


@add(r"SELECT count(*) AS n FROM movie_info WHERE regexp_matches(info, '^(?:[1-9]\d*|0)?(?:\.\d+)?$') AND try_cast(info AS DOUBLE) <= 50")
def numeric_text_guard(t: Tables) -> DataFrame:
    return t.movie_info.where(S.numeric_text(col("info")) <= 50).agg(rows())


@add("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)")
def in_subquery_having(t: Tables) -> DataFrame:
    busy = t.orders.groupBy("o_custkey").agg(rows()).where("n > 12").select("o_custkey")
    return t.orders.join(busy, "o_custkey", "left_semi").agg(rows())


@add("SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 20)")
def in_subquery_topk(t: Tables) -> DataFrame:
    top = t.lineitem.groupBy("l_partkey").agg(rows()).orderBy(F.desc("n"), "l_partkey").limit(20).select("l_partkey")
    return t.lineitem.join(top, "l_partkey", "left_semi").agg(rows())


# ---- joins


@add(
    "SELECT count(*) AS n FROM customer AS c, orders AS o, lineitem AS l, nation AS n WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey"
    " AND n.n_nationkey = c.c_nationkey AND n.n_name IN ('NATION_1', 'NATION_3', 'NATION_9') AND l.l_quantity > 25"
)
def star_join_count(t: Tables) -> DataFrame:
    nation = t.nation.where(col("n_name").isin("NATION_1", "NATION_3", "NATION_9"))
    joined = t.customer.join(nation, col("c_nationkey") == col("n_nationkey")).join(t.orders, col("c_custkey") == col("o_custkey"))
    return joined.join(t.lineitem.where("l_quantity > 25"), col("o_orderkey") == col("l_orderkey")).agg(rows())


@add(
    "SELECT count(*) AS n FROM title AS t, movie_info AS a, movie_info AS b WHERE t.id = a.movie_id AND t.id = b.movie_id AND a.movie_id = b.movie_id"
    " AND a.info_type_id = 3 AND b.info_type_id = 8"
)
def cyclic_join_count(t: Tables) -> DataFrame:
    a, b = t("movie_info", "a").where("info_type_id = 3"), t("movie_info", "b").where("info_type_id = 8")
    joined = t("title", "t").join(a, col("t.id") == col("a.movie_id"))
    return joined.join(b, (col("t.id") == col("b.movie_id")) & (col("a.movie_id") == col("b.movie_id"))).agg(rows())


@add("SELECT count(*) AS n FROM lineitem AS l1, lineitem AS l2 WHERE l1.l_orderkey = l2.l_orderkey AND l1.l_linenumber != l2.l_linenumber")
def self_join_neq(t: Tables) -> DataFrame:
    on = (col("l1.l_orderkey") == col("l2.l_orderkey")) & (col("l1.l_linenumber") != col("l2.l_linenumber"))
    return t("lineitem", "l1").join(t("lineitem", "l2"), on).agg(rows())


@add("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def semi_join(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(returned, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(rows())


@add("SELECT count(*) AS n FROM movie_info WHERE movie_id IS NOT NULL AND movie_id NOT IN (SELECT id FROM title WHERE id IS NOT NULL)")
def anti_join(t: Tables) -> DataFrame:
    return t.movie_info.where("movie_id IS NOT NULL").join(t.title.select(col("id").alias("movie_id")), "movie_id", "left_anti").agg(rows())


@add("SELECT h, n FROM (VALUES ('BROADCAST'), ('MERGE'), ('SHUFFLE_HASH')) AS x(h), (SELECT count(*) AS n FROM orders, customer WHERE o_custkey = c_custkey) AS y")
def join_method_hints(t: Tables) -> DataFrame:
    out = None
    for hint in ("MERGE", "SHUFFLE_HASH"):
        one = t.orders.join(t.customer.hint(hint), col("o_custkey") == col("c_custkey")).agg(rows()).withColumn("h", F.lit(hint))
        out = one if out is None else out.unionByName(one)
    # nations have a fixed number of rows: the one side here that may be broadcast by hint
    small = t.customer.join(t.nation.hint("BROADCAST"), col("c_nationkey") == col("n_nationkey"))
    one = t.orders.join(small, col("o_custkey") == col("c_custkey")).agg(rows()).withColumn("h", F.lit("BROADCAST"))
    return out.unionByName(one)


@add("SELECT s.stat_id, r.runtime, q.n_tables FROM qrep AS q JOIN runtimes AS r ON r.sql_key = q.sql_key JOIN stats AS s ON s.stat_id = q.qid AND s.summary_type = 'value' WHERE r.runtime < 909")
def result_merge(t: Tables) -> DataFrame:
    joined = t.qrep.join(t.runtimes.where("runtime < 909"), "sql_key")
    return joined.join(t.stats.where("summary_type = 'value'"), col("stat_id") == col("qid")).select("stat_id", "runtime", "n_tables")


@add(
    "SELECT i.info, count(m.movie_id) AS n FROM info_type AS i LEFT JOIN movie_info AS m ON m.info_type_id = i.id GROUP BY i.info"
)
def left_join_count(t: Tables) -> DataFrame:
    return t("info_type", "i").join(t("movie_info", "m"), col("m.info_type_id") == col("i.id"), "left").groupBy("i.info").agg(F.count("m.movie_id").alias("n"))


@add("SELECT stat_id, k.label FROM stats AS s JOIN (VALUES ('train', 1), ('val', 2)) AS k(name, label) ON s.samples_type = k.name WHERE s.epoch = 3")
def map_lookup(t: Tables) -> DataFrame:
    mapping = F.create_map(F.lit("train"), F.lit(1), F.lit("val"), F.lit(2))
    return t.stats.where("epoch = 3").select("stat_id", F.try_element_at(mapping, col("samples_type")).alias("label")).where("label IS NOT NULL")


# ---- aggregates


@add("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def group_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(rows())


@add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def group_count_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(rows()).where("n > 10")


@add("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(*) > 50 AND count(DISTINCT l_partkey) < 900")
def count_distinct_having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(rows(), F.count_distinct("l_partkey").alias("parts")).where("n > 50 AND parts < 900").select("l_suppkey", "parts")


@add("SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1")
def min_max_group(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@add("SELECT DISTINCT kind_id, production_year FROM title")
def distinct_project(t: Tables) -> DataFrame:
    return t.title.select("kind_id", "production_year").distinct()


@add("SELECT count(*) AS n FROM (SELECT DISTINCT production_year FROM title)")
def distinct_count_with_null(t: Tables) -> DataFrame:
    return t.title.select("production_year").distinct().agg(rows())


@add("SELECT (SELECT production_year FROM title WHERE production_year IS NOT NULL ORDER BY 1 LIMIT 1) AS low, (SELECT production_year FROM title WHERE production_year IS NOT NULL ORDER BY 1 DESC LIMIT 1) AS high")
def min_max_by_order(t: Tables) -> DataFrame:
    return t.title.agg(F.min("production_year").alias("low"), F.max("production_year").alias("high"))


@add("SELECT kind_id, production_year, count(*) AS n FROM title GROUP BY ALL HAVING count(*) > 1")
def joint_frequency(t: Tables) -> DataFrame:
    return t.title.groupBy("kind_id", "production_year").agg(rows()).where("n > 1")


_DESCRIBE = ", ".join(f"round(quantile_cont(p_retailprice, {q}), 6) AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75))


@add(f"SELECT p_brand, count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS low, {_DESCRIBE}, max(p_retailprice) AS high FROM part GROUP BY 1")
def describe_by_group(t: Tables) -> DataFrame:
    v = "p_retailprice"
    simple = t.part.groupBy("p_brand").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
    ranks = exact_percentiles(t.part, ["p_brand"], v, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return simple.join(ranks.select("p_brand", "n", *(F.round(p, 6).alias(p) for p in ("p25", "p50", "p75"))), "p_brand")


@add("SELECT template, round(avg(num_samples), 6) AS mean FROM stats WHERE summary_type <> 'value' GROUP BY 1")
def group_mean(t: Tables) -> DataFrame:
    return t.stats.where("summary_type <> 'value'").groupBy("template").agg(F.round(F.avg("num_samples"), 6).alias("mean"))


@add("SELECT template_name, count(DISTINCT sql_key) AS queries, count(split) AS with_split FROM qrep GROUP BY 1")
def group_nunique(t: Tables) -> DataFrame:
    return t.qrep.groupBy("template_name").agg(F.count_distinct("sql_key").alias("queries"), F.count("split").alias("with_split"))


@add("SELECT template_name, n_tables, count(*) AS n FROM qrep GROUP BY 1, 2")
def plans_per_key(t: Tables) -> DataFrame:
    return t.qrep.groupBy("template_name", "n_tables").agg(rows())


@add("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS ratio FROM lineitem GROUP BY 1")
def ratio_of_sums(t: Tables) -> DataFrame:
    net = F.sum(col("l_extendedprice") * (1 - col("l_discount")))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(net / F.sum("l_extendedprice"), 6).alias("ratio"))


@add("SELECT CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM part WHERE p_retailprice > 1000 GROUP BY 1")
def binned_counts(t: Tables) -> DataFrame:
    return t.part.where("p_retailprice > 1000").groupBy(F.when(col("p_size") <= 10, 0).when(col("p_size") <= 25, 1).otherwise(2).alias("bin")).agg(rows())


@add("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_matrix(t: Tables) -> DataFrame:
    made = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return made.select("o_orderpriority", *(F.coalesce(col(c), F.lit(0)).alias(c.lower()) for c in "FOP"))


# ---- windows, bins, ranks


@add("SELECT bin, count(*) AS n, min(s_acctbal) AS low FROM (SELECT s_acctbal, ntile(7) OVER (ORDER BY s_acctbal, s_suppkey) AS bin FROM supplier) GROUP BY 1")
def ntile_bins(t: Tables) -> DataFrame:
    return windows.ntile_global(t.supplier, 7, ["s_acctbal", "s_suppkey"], "bin").groupBy("bin").agg(rows(), F.min("s_acctbal").alias("low"))


@add(
    "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rn, count(*) OVER () // 8 AS size FROM customer)"
    " SELECT c_custkey, (rn // size)::BIGINT AS chunk FROM r WHERE rn // size < 8"
)
def quantile_chunk(t: Tables) -> DataFrame:
    return windows.quantile_chunks(t.customer, 8, ["c_acctbal", "c_custkey"], "chunk").select("c_custkey", "chunk")


@add(
    "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p_retailprice, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM part)"
    " SELECT p_partkey, len(list_filter(edges, lambda x: x < p_retailprice))::BIGINT AS bin FROM part, e"
)
def qcut_bins(t: Tables) -> DataFrame:
    return windows.qcut(t.part, "p_retailprice", 5, "bin").select("p_partkey", "bin")


@add("SELECT k.id AS bin, count(*) AS n FROM title AS t JOIN kind_type AS k ON t.kind_id = k.id GROUP BY 1")
def value_to_bin(t: Tables) -> DataFrame:
    bins = t.kind_type.select(col("id").alias("kind_id"), col("id").alias("bin"))
    return t.title.join(bins, "kind_id").groupBy("bin").agg(rows())


@add("SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS UNBOUNDED PRECEDING) AS upto FROM part")
def running_max_by_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.part.select("p_partkey", F.max("p_retailprice").over(w).alias("upto"))


@add("SELECT s_suppkey, max(s_nationkey) OVER (ORDER BY s_acctbal, s_suppkey ROWS UNBOUNDED PRECEDING) AS upto FROM supplier")
def running_max_rank(t: Tables) -> DataFrame:
    return windows.running_max(t.supplier, "s_nationkey", ["s_acctbal", "s_suppkey"], "upto").select("s_suppkey", "upto")


@add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmax_per_group(t: Tables) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -col("o_orderkey"))).alias("b")
    return t.orders.groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


_PICK = "(o_orderkey * 950706376 + 11) % 2147483647"


@add(f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_PICK}, o_orderkey) AS r FROM orders) WHERE r = 1")
def random_per_group(t: Tables) -> DataFrame:
    pick = F.pmod(col("o_orderkey") * 950706376 + 11, F.lit(2147483647))
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(pick, col("o_orderkey"))).alias("o_orderkey"))


@add(
    "WITH lim AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),"
    " b AS (SELECT least(9, floor((o_totalprice - lo) / (hi - lo) * 10))::INT AS bin FROM orders, lim),"
    " g AS (SELECT bin, count(*) AS c FROM b GROUP BY 1)"
    " SELECT bin, round(sum(c) OVER (ORDER BY bin) / sum(c) OVER (), 6)::DOUBLE AS share FROM g"
)
def ecdf(t: Tables) -> DataFrame:
    return windows.ecdf(t.orders, "o_totalprice", 10)


@add(
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.2) AS lo, quantile_cont(o_totalprice, 0.8) AS hi FROM orders)"
    " SELECT CASE WHEN o_totalprice >= hi THEN 'high' WHEN o_totalprice <= lo THEN 'low' ELSE 'mid' END AS band, count(*) AS n FROM orders, q GROUP BY 1"
)
def quantile_bands(t: Tables) -> DataFrame:
    return windows.quantile_bands(t.orders, "o_totalprice", "band").groupBy("band").agg(rows())


@add(
    "SELECT b, count(*) AS n FROM (SELECT CASE WHEN p_retailprice > 1 AND p_retailprice < 10 THEN 0 WHEN p_retailprice > 10 AND p_retailprice < 100 THEN 1"
    " WHEN p_retailprice > 100 AND p_retailprice < 1000 THEN 2 WHEN p_retailprice > 1000 AND p_retailprice < 10000 THEN 3 ELSE 4 END AS b FROM part) GROUP BY 1"
)
def log_bucket(t: Tables) -> DataFrame:
    return t.part.groupBy(S.log_bucket(col("p_retailprice"), 10, 4).alias("b")).agg(rows())


# ---- sort, limit, top-k


@add("SELECT template_name, n FROM (SELECT template_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, template_name NULLS FIRST) AS r FROM qrep GROUP BY 1) WHERE r <= 100")
def topk_group_limit(t: Tables) -> DataFrame:
    return t.qrep.groupBy("template_name").agg(rows()).orderBy(F.desc("n"), F.asc_nulls_first("template_name")).limit(100)


@add("SELECT stat_id, loss FROM (SELECT DISTINCT stat_id, loss FROM stats WHERE loss IS NOT NULL AND NOT isnan(loss)) ORDER BY loss DESC, stat_id LIMIT 20")
def head_by_loss(t: Tables) -> DataFrame:
    valid = t.stats.where("loss IS NOT NULL AND NOT isnan(loss)").select("stat_id", "loss").distinct()
    return valid.orderBy(F.desc("loss"), "stat_id").limit(20)


# ---- sets, deduplication


@add("SELECT sql_key, min(qid) AS qid FROM qrep GROUP BY 1")
def dedup_keep_first(t: Tables) -> DataFrame:
    return setops.keep_first(t.qrep, ["sql_key"], ["qid"], ["qid"])


@add("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def concat_frames(t: Tables) -> DataFrame:
    return setops.concat([t.customer.select(col("c_nationkey").alias("k")), t.supplier.select(col("s_nationkey").alias("k"))])


@add("SELECT card_key FROM (SELECT DISTINCT card_key, samples_type FROM stats WHERE card_key IS NOT NULL AND samples_type IS NOT NULL) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT samples_type) FROM stats WHERE card_key IS NOT NULL)")
def common_keys_all_groups(t: Tables) -> DataFrame:
    return setops.common_keys(t.stats.where("card_key IS NOT NULL AND samples_type IS NOT NULL"), "card_key", "samples_type")


@add("SELECT sql_key FROM qrep WHERE split = 'train' INTERSECT SELECT sql_key FROM qrep WHERE split = 'test'")
def intersect_ids(t: Tables) -> DataFrame:
    return t.qrep.where("split = 'train'").select("sql_key").intersect(t.qrep.where("split = 'test'").select("sql_key"))


@add("SELECT sql_key FROM qrep WHERE split = 'train' UNION SELECT sql_key FROM qrep WHERE split = 'test'")
def union_ids(t: Tables) -> DataFrame:
    return t.qrep.where("split = 'train'").select("sql_key").union(t.qrep.where("split = 'test'").select("sql_key")).distinct()


@add("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def except_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").exceptAll(t.lineitem.select("l_orderkey").distinct()).distinct()


_GRAPH_IDS = "'{\"nodes\": [{\"id\": \"VARCHAR\", \"real_name\": \"VARCHAR\", \"pred_cols\": [\"VARCHAR\"]}]}'"


@add(
    f"WITH g AS (SELECT qid, split, unnest(from_json(join_graph, {_GRAPH_IDS}).nodes) AS x FROM qrep WHERE split IN ('train', 'test')),"
    " i AS (SELECT qid, split, unnest(list_append(x.pred_cols, x.real_name)) AS id FROM g),"
    " s AS (SELECT qid, split, list(DISTINCT id) AS a FROM i WHERE id IS NOT NULL GROUP BY 1, 2), k AS (SELECT DISTINCT list_sort(a) AS b FROM s WHERE split = 'train'),"
    " p AS (SELECT DISTINCT list_sort(a) AS a FROM s WHERE split = 'test'), m AS (SELECT a, max(len(list_intersect(a, b)) / len(a)) AS best FROM p, k GROUP BY 1)"
    " SELECT s.qid, round(best, 6) AS best FROM s JOIN m ON list_sort(s.a) = m.a WHERE split = 'test'"
)
def best_overlap(t: Tables) -> DataFrame:
    """Tables and filter columns of every test query, against those of all training queries."""
    nodes = Q.join_nodes(t.qrep).select("qid", F.explode(F.array_append("pred_cols", col("real_name"))).alias("id")).where("id IS NOT NULL")
    sets = nodes.groupBy("qid").agg(F.collect_set("id").alias("ids")).join(t.qrep.select("qid", "split"), "qid")  # the ids of one query
    return setops.best_overlap(sets.where("split = 'test'"), sets.where("split = 'train'"), "qid", "ids").select("qid", F.round("best", 6).alias("best"))


@add("SELECT count(*) FILTER (WHERE p_brand IN ('Brand#2', 'Brand#4', 'Brand#17')) AS within, count(*) FILTER (WHERE p_brand NOT IN ('Brand#2', 'Brand#4', 'Brand#17')) AS beyond FROM part")
def subset_test(t: Tables) -> DataFrame:
    known = F.array(*map(F.lit, ("Brand#2", "Brand#4", "Brand#17")))
    missing = F.size(F.array_except(F.array("p_brand"), known))
    return t.part.agg(F.count_if(missing == 0).alias("within"), F.count_if(missing > 0).alias("beyond"))


# ---- scalar functions

_CHUNKS = "0"
for _at in range(1, 41, 8):
    _CHUNKS = f"(({_CHUNKS} * {2**32 % 1000} + ('0x' || substr(sha1(p_name), {_at}, 8))::BIGINT) % 1000)"


@add(f"SELECT p_partkey, {_CHUNKS}::BIGINT AS bucket FROM part")
def sha1_bucket(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.sha1_bucket(col("p_name"), 1000).alias("bucket"))


@add("SELECT p_name, array_to_string(list_transform(range(1, greatest(len(p_name) - 1, 1)::BIGINT), lambda i: substr(p_name, i::BIGINT, 3)), '|') AS grams FROM part")
def char_ngrams(t: Tables) -> DataFrame:
    return t.part.select("p_name", F.array_join(S.ngrams(col("p_name"), 3), "|").alias("grams"))


@add(
    "WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"
    " SELECT c_custkey, round(least(1, greatest(0, (c_acctbal - lo) / (hi - lo))), 6) AS share FROM customer, m"
)
def minmax_norm(t: Tables) -> DataFrame:
    low_high = t.customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))  # one row
    return t.customer.crossJoin(F.broadcast(low_high)).select("c_custkey", F.round(S.min_max(col("c_acctbal"), col("lo"), col("hi")), 6).alias("share"))


@add("SELECT o_orderkey, round(o_totalprice, 4) AS back FROM orders")
def log_norm_roundtrip(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(S.log_denorm(S.log_norm(col("o_totalprice"), 0.5, 14.0), 0.5, 14.0), 4).alias("back"))


_PAIR = "(SELECT c_custkey, (c_custkey % 17)::DOUBLE AS y, (c_nationkey * 3)::DOUBLE AS e FROM customer)"


@add(
    "SELECT c_custkey, round(CASE WHEN greatest(y, 1) > greatest(e, 1) THEN -(greatest(y, 1) / greatest(e, 1)) ELSE greatest(e, 1) / greatest(y, 1) END, 6) AS signed_q,"
    f" round(greatest(greatest(y, 1) / greatest(e, 1), greatest(e, 1) / greatest(y, 1)), 6) AS q FROM {_PAIR}"
)
def signed_qerror(t: Tables) -> DataFrame:
    y, e = col("c_custkey") % 17, col("c_nationkey") * 3
    return t.customer.select("c_custkey", F.round(S.signed_qerror(y, e), 6).alias("signed_q"), F.round(S.qerror(y, e), 6).alias("q"))


@add(
    "SELECT c_custkey, round(abs(e - y) / greatest(1, y), 6) AS rel, abs(e - y) AS abs_err,"
    f" round(CASE WHEN y < 1 THEN (e - y) * (e - y) ELSE 0.5 * (e / y - 1) * (e / y - 1) END, 6) AS scaled FROM {_PAIR}"
)
def rel_abs_error(t: Tables) -> DataFrame:
    y, e = (col("c_custkey") % 17).cast("double"), (col("c_nationkey") * 3).cast("double")
    return t.customer.select(
        "c_custkey", F.round(S.relative_error(y, e, 1.0), 6).alias("rel"), S.absolute_error(y, e).alias("abs_err"), F.round(S.scaled_norm_loss(y, e), 6).alias("scaled")
    )


@add("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 5) AS c FROM embeddings")
def cosine_similarity(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(S.cosine(col("embedding"), F.reverse("embedding")), 5).alias("c"))


@add(r"SELECT stat_id, array_to_string(regexp_extract_all(template, '\d+'), ',') AS ints FROM stats WHERE summary_type = 'max' AND template IS NOT NULL")
def integers_in_text(t: Tables) -> DataFrame:
    return t.stats.where("summary_type = 'max' AND template IS NOT NULL").select("stat_id", F.array_join(F.transform(S.integers_in(col("template")), lambda x: x.cast("string")), ",").alias("ints"))


@add("SELECT qid, replace(sql, '''', '') AS bare, regexp_matches(sql, '[0-9]') AS digits, len(sql) AS n FROM qrep")
def pattern_features(t: Tables) -> DataFrame:
    return t.qrep.select("qid", S.strip_quotes(col("sql")).alias("bare"), S.has_digit(col("sql")).alias("digits"), F.length("sql").cast("long").alias("n"))


@add("SELECT 10::BIGINT AS n, 45::BIGINT AS c2, 252::BIGINT AS c5, round(2.5758293035489004 * 3 / sqrt(16), 6) AS half")
def combinatorics(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(10).cast("long").alias("n"), S.choose(10, 2).alias("c2"), S.choose(10, 5).alias("c5"), F.round(S.half_interval(F.lit(3.0), F.lit(16)), 6).alias("half"))


@add(r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) AS w FROM part) GROUP BY 1")
def word_counts(t: Tables) -> DataFrame:
    return t.part.select(F.explode(S.words(col("p_name"))).alias("w")).groupBy("w").agg(rows())


@add("SELECT qid, array_to_string(list_filter(string_split(sql, ' '), lambda w: contains(w, '_id')), ' ') AS kept FROM qrep WHERE sql IS NOT NULL")
def keep_matching_words(t: Tables) -> DataFrame:
    return t.qrep.where("sql IS NOT NULL").select("qid", F.array_join(S.keep_matching(F.split("sql", " "), "_id"), " ").alias("kept"))


QUERIES, ORACLES = R.queries, R.oracles
