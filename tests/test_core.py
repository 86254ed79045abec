import math
import os
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinlens.functions import scalars as S
from joinlens.operators import estimators, metrics, models, pgm, sampling, setops, stats, windows
from joinlens.operators.percentiles import exact_percentiles
from joinlens.queries.learned import TEMPLATE
from joinlens.sources import files
from joinlens.workload import generator as G
from joinlens.workload import parser
from joinlens.workload.spec import Edge, JoinQuery, Predicate


def test_percentiles(spark):
    rng = random.Random(1)
    values = {"hot": [rng.choice([1.0, rng.gauss(0, 100)]) for _ in range(3001)], "one": [5.0], "inf": [1.0, 2.0, float("inf")], None: [rng.random() for _ in range(10)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    found = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    assert set(found) == set(values)
    for g, vs in values.items():
        for name, q in shares.items():
            if g != "inf":
                assert found[g][name] == pytest.approx(np.percentile(vs, q * 100))
    assert (found["inf"]["c"], found["inf"]["e"]) == (2.0, float("inf"))


def test_ranks_without_one_task(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 50)) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r.id: r.at for r in windows.global_rank(df, ["v", "id"], "at").collect()} == {r[0]: i + 1 for i, r in enumerate(order)}
    tiles = [r[0] for r in windows.ntile_global(df, 7, ["v", "id"], "t").groupBy("t").count().orderBy("t").select("count").collect()]
    assert tiles == [144, 144, 143, 143, 143, 143, 143]
    top, want = -1, {}
    for i, v in order:
        top = max(top, v)
        want[i] = top
    assert {r.id: r.m for r in windows.running_max(df, "v", ["v", "id"], "m").collect()} == want


def test_set_operations(spark):
    probes = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [9]), (3, [])], "k int, ids array<int>")
    known = spark.createDataFrame([(7, [1, 2]), (8, [2, 3, 4]), (9, [4, 3, 2])], "k int, ids array<int>")
    assert {tuple(r) for r in setops.best_overlap(probes, known, "k", "ids").collect()} == {(1, 0.75), (2, 0.0), (3, 0.0)}
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 3), ("b", 4)], "k string, y int")
    assert [tuple(r) for r in setops.join_null_safe(left, right, ["k"]).collect()] == [(None, 1, 3)]


def test_scalars(spark):
    import hashlib

    df = spark.createDataFrame([("abc%12",), ("",), ("x",)], "s string")
    for n in (10, 1000, 9973):
        got = [r[0] for r in df.select(S.sha1_bucket(F.col("s"), n)).collect()]
        assert got == [int(hashlib.sha1(s.encode()).hexdigest(), 16) % n for s in ("abc%12", "", "x")]
    assert [r[0] for r in df.select(S.ngrams(F.col("s"), 2)).collect()] == [["ab", "bc", "c1", "12"], [], []]
    nums = spark.createDataFrame([("1.5",), ("",), ("x",), ("007",), (".5",), (None,)], "s string")
    assert [r[0] for r in nums.select(S.numeric_text(F.col("s"))).collect()] == [1.5, None, None, None, 0.5, None]
    powers = spark.createDataFrame([(1.0,), (5.0,), (10.0,), (11.0,), (1e9,)], "v double")
    assert [r[0] for r in powers.select(S.log_bucket(F.col("v"), 10, 3)).collect()] == [3, 0, 3, 1, 3]
    assert spark.range(1).select(S.qerror(F.lit(0), F.lit(0)), S.signed_qerror(F.lit(8), F.lit(2)), S.choose(10, 3)).first()[:] == (1.0, -4.0, 120)


def test_qerrors_drop_incomplete_queries(spark):
    df = spark.createDataFrame([("a", "x", 1, 0, 5), ("a", "x y", 2, 100, 10), ("b", "x", 1, None, 5), ("b", "y", 1, 2, 2)], "qid string, subset string, n_tables int, actual long, expected long")
    found = {r.subset: (r.signed_q, r.q) for r in metrics.subset_qerrors(df).collect()}
    assert found == {"x": (5.0, 5.0), "x y": (-10.0, 10.0)}
    cube = metrics.cube_summary(metrics.subset_qerrors(df), "q", "qid", "n_tables")
    assert {(r.qid, r.n_tables, r.loss) for r in cube.where("summary_type = 'max'").collect()} == {("a", "1", 5.0), ("a", "2", 10.0), ("a", "all", 10.0), ("all", "1", 5.0), ("all", "2", 10.0), ("all", "all", 10.0)}


def test_estimators(spark):
    df = spark.createDataFrame([("q", "a", 1, 10, 5, 100), ("q", "b", 1, 20, 3, 40), ("q", "a b", 2, 30, 9, 4000)], "qid string, subset string, n_tables int, actual long, expected long, total long")
    rank = {r.subset: r.est for r in estimators.estimate("true_rank", df).collect()}
    assert rank == {"a": 5.0, "b": 5.0, "a b": 9.0}
    assert {r.subset: r.est for r in estimators.estimate("independent", df).collect()}["a b"] == pytest.approx(4000 * 0.1 * 0.5)
    noisy = {r.subset: r.est for r in estimators.estimate("true_random", df, percent=10.0).collect()}
    assert all(abs(noisy[s] - v) <= v * 0.1 + 1e-9 for s, v in (("a", 10), ("b", 20), ("a b", 30)))
    with pytest.raises(ValueError):
        estimators.estimate("none", df)


def test_samples(spark):
    df = spark.range(100_000).withColumnRenamed("id", "k")
    assert abs(sampling.hash_sample(df, "k", 0.1).count() - 10_000) < 300
    assert sampling.sample_or_all(df.limit(10), "k", 0.1).count() == 10
    tables = {"f": spark.createDataFrame([(i, i % 50) for i in range(2000)], "id long, d long"), "d": spark.createDataFrame([(i,) for i in range(50)], "d long")}
    made = sampling.sample_database(lambda n: tables[n], {"f": "id", "d": "d"}, [("f", "d", "d", "d")], 0.2)
    assert made["f"].join(made["d"], "d", "left_anti").count() == 0 and made["d"].count() == made["d"].distinct().count()


def test_wander_join_is_unbiased(spark):
    rng = random.Random(3)
    t = {"x": spark.createDataFrame([(i, rng.randint(0, 5)) for i in range(60)], "id int, k int"), "y": spark.createDataFrame([(i, rng.randint(0, 7)) for i in range(80)], "id int, k int")}
    q = JoinQuery("w", {"a": "x", "b": "y"}, (Edge("a", "k", "b", "k"),))
    want = q.join(lambda n: t[n], ("a", "b")).count()
    got = sampling.wander_join(spark, lambda n: t[n], q, 4000, order=["a", "b"]).where("subset = 'a b'").first()
    assert abs(got.estimate - want) <= 3 * got.half_interval + 1
    early = sampling.wander_join(spark, lambda n: t[n], q, 4000, order=["a", "b"], successes=100).where("subset = 'a b'").first()
    assert early.half_interval > got.half_interval and abs(early.estimate - want) <= 4 * early.half_interval + 1
    same = sampling.wander_join(spark, lambda n: t[n], q, 4000, order=["a", "b"], successes=10**6).where("subset = 'a b'").first()
    assert same == got
    empty = JoinQuery("e", {"a": "x", "b": "y"}, (Edge("a", "k", "b", "k"),), {"b": (Predicate("k", "eq", (99,)),)})
    assert sampling.wander_join(spark, lambda n: t[n], empty, 10, order=["a", "b"]).where("subset = 'a b'").first().estimate == 0


@pytest.mark.parametrize("most", [sampling.WINDOW_ROWS, 0])
def test_picks_and_numbers(spark, monkeypatch, most):
    monkeypatch.setattr(sampling, "WINDOW_ROWS", most)
    rng = random.Random(7)
    rows = [(rng.choice([5, 5, 5, rng.randint(-10_000, 10_000)]), i) for i in range(900)]
    df, order = spark.createDataFrame(rows, "k long, i int"), sorted(rows)
    picks = sorted({rng.randrange(900) for _ in range(60)})
    found = sampling.numbered_picks(df, spark.createDataFrame([(p,) for p in picks], "at long"), ["k", "i"], "at", sampling.key_limits(df, "k"), slices=50)
    assert {r["at"]: (r.k, r.i) for r in found.collect()} == {p: order[p] for p in picks}
    text = df.select(F.col("k").cast("string").alias("k"), "i")
    assert sampling.numbered_picks(text, spark.createDataFrame([(3,)], "at long"), ["k", "i"], "at", sampling.key_limits(text, "k")).count() == 1
    numbered = sampling.number_within(df, ["k"], ["k", "i"], "no", 900)
    assert {(r.k, r.i): r.no for r in numbered.collect()} == {(k, i): sum(a == k and b < i for a, b in rows) for k, i in rows}


def test_best_overlap_equals_brute_force(spark):
    rng = random.Random(11)

    def ids():
        return [rng.choice([0, 0, 1, rng.randint(2, 9), rng.randint(10, 60), None]) for _ in range(rng.randint(0, 9))]

    probes, known = [(i, ids()) for i in range(150)], [(i, ids()) for i in range(120)]
    schema = "k int, ids array<int>"
    found = {r.k: r.best for r in setops.best_overlap(spark.createDataFrame(probes, schema), spark.createDataFrame(known, schema), "k", "ids").collect()}
    for k, a in probes:
        a = set(a) - {None}
        assert found[k] == (max(len(a & set(b)) for _, b in known) / len(a) if a else 0)


def test_tree_model_is_exact_on_a_tree(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        a = rng.choice("pq")
        rows.append((a, rng.choice("xy" if a == "p" else "yz"), rng.choice("12"), rng.choice([None, "k"])))
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    joint, marginal, tree = pgm.fit(df, ["a", "b", "c", "d"])
    assert {frozenset(e) for e in tree} >= {frozenset("ab")} and len(tree) == 3
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    filters = spark.createDataFrame([(1, "a", "p"), (1, "b", "y"), (2, "b", "unseen")], "qid int, col_name string, value string")
    found = {r.qid: r.p for r in pgm.infer(joint, marginal, tree, queries, filters).collect()}
    assert found[1] == pytest.approx(sum(r[0] == "p" and r[1] == "y" for r in rows) / len(rows)) and found[2] == 0 and found[3] == pytest.approx(1)


def test_selectivity_and_stats(spark):
    assert stats.selectivity(Predicate("c", "range", (0, 5)), 10, 0, 10, 0, 10) == 0.5
    assert stats.selectivity(Predicate("c", "null"), 10, 0, 10, 3, 10) == 0.3
    found = stats.column_stats(spark.createDataFrame([(1, None), (1, "x")], "a int, b string"), ["a", "b"]).collect()
    assert [(r.col_name, r.num_values, r.null_values) for r in found] == [("a", 1, 0), ("b", 2, 1)]


def test_parser():
    p = parser.parse("SELECT COUNT(*) FROM title AS t, name n WHERE t.id = n.id AND (t.a IN ('x','y') OR t.a IS NULL) AND t.y > 5 AND t.y <= 9 AND n.g ILIKE '%q%' AND t.z BETWEEN 1 AND 2 AND n.v = '8.0';")
    assert p.tables == {"t": "title", "n": "name"} and p.edges == [Edge("t", "id", "n", "id")]
    assert [(x["column"], x["op"], x["values"]) for x in p.preds] == [("t.a", "in", ["x", "y"]), ("t.a", "in", ["NULL"]), ("t.y", "lt", ["5", "9"]), ("n.g", "like", ["%q%"]), ("t.z", "lt", ["1", "2"]), ("n.v", "eq", ["8.0"])]
    for bad in ("DELETE FROM t", "SELECT a", "SELECT a FROM t WHERE EXISTS (SELECT 1)", "SELECT a FROM t WHERE ~"):
        with pytest.raises(parser.UnsupportedQuery):
            parser.parse(bad)
    q = parser.to_query("select count(*) from t as a, u as b where a.k = b.k and a.v in ('it''s')", "q")
    assert q.count_sql() == "SELECT COUNT(*) FROM t AS a, u AS b WHERE a.k = b.k AND a.v IN ('it''s')"


def test_generator(spark):
    spark.createDataFrame([(i, f"b{i % 5}", i % 30, f"small thing {i % 7}") for i in range(300)], "p_partkey long, p_brand string, p_size int, p_name string").createOrReplaceTempView("part")
    spark.createDataFrame([(i,) for i in range(300)], "l_partkey long").createOrReplaceTempView("lineitem")
    one = G.generate(spark, TEMPLATE, 8, seed=3)
    assert one and one == G.generate(spark, TEMPLATE, 8, seed=3) and len(set(one)) == len(one)
    for q in one:
        spark.sql(q).collect()
    assert not G.verify(spark, "SELECT COUNT(*) FROM missing AS m")
    assert len(G.synthetic_queries(["a", "b"], "t", {"a": [1, 2], "b": [3]}, 5)) >= 1
    filled = G.fill_v1("x IN ('SELECT c') AND y > Xy AND y < Yy", {"c": [1]}, {"y": [3, 9]})
    assert filled.startswith("x IN ('1') AND y > ")


def test_generator_draws_from_the_whole_domain(spark):
    spark.range(25_000).selectExpr("format_string('v%05d', id) AS v", "id % 7 AS k").createOrReplaceTempView("wide")
    domain, group = G.Domain(spark, {}), {"keys": ["K"], "columns": ["w.v"], "sampling_method": "quantile", "num_quantiles": 5, "min_samples": 3, "max_samples": 3}
    rows, size = domain.rows("SELECT v, COUNT(*) FROM wide GROUP BY v", 1)
    assert size == 25_000 and G._numbered(rows, [25_000, 1, 1]) == [("v24999", 1, 25_000), ("v00000", 1, 1), ("v00000", 1, 1)]
    drawn = {int(v) for seed in range(12) for v in re.findall(r"v(\d+)'", G._in_list(random.Random(seed), group, rows, size)["K"])}
    assert max(drawn) >= 20_000 and {v // 5000 for v in drawn} == {0, 1, 2, 3, 4}
    counts = {r.p: r.n for r in G.prefix_counts(rows, 3, 6).collect()}
    brute = Counter(f"v{i:05d}"[:k] for i in range(25_000) for k in range(3, 7))
    assert counts == brute and len(counts) > 10_000
    two, _ = domain.rows("SELECT * FROM VALUES ('Small smart thing'), ('small'), (NULL) AS x(v)", 1)
    assert {r.p: r.n for r in G.prefix_counts(two, 3, 3).collect()} == {"sma": 2, "thi": 1}


def test_ilike_bands(spark):
    words = [("rare%03d" % i, 1) for i in range(200)] + [("middle", 40), ("midway", 30), ("hot", 5000), ("hotel", 900)]
    spark.createDataFrame([(f"{w} {w}", n) for w, n in words], "v string, n long").createOrReplaceTempView("skewed")
    rows = G.Domain(spark, {}).texts("SELECT v, n FROM skewed")
    size = Counter()
    for w, n in words:
        for k in range(3, min(len(w), 5) + 1):
            size[w[:k]] += n
    base = {"min_chars": 3, "max_chars": 5, "min_count": 2}
    for thresholds in ([35, 75], [30], [6000]):
        group = base | {"thresholds": thresholds}
        for seed in range(2):
            low, high = G.size_band(random.Random(seed), group, None, 0)
            assert low in thresholds and (high in thresholds or high == float("inf"))
            found, possible = G.pick_prefix(random.Random(seed), group, rows), {p for p, n in size.items() if low < n < high}
            assert found in possible if possible else found is None
    counts, total = [n for _, n in words], sum(n for _, n in words)
    quantiles, bands = base | {"num_quantiles": 2, "min_count": 0}, set()
    for seed in (0, 1, 2, 8):
        bands.add(G.size_band(random.Random(seed), quantiles, G.word_counts(rows), total))
    mid = float(np.percentile(counts, 50))
    assert bands == {(1.0, mid), (mid, 5000.0), (0, total / 2), (total / 2, total)}
    # weighted tries come first and succeed 97 times in 100: few picks are rare words, though most prefixes are
    picks = [G.pick_prefix(random.Random(seed), base | {"min_count": 1}, rows) for seed in range(8)]
    assert sum(p.startswith("hot") for p in picks) >= 6


def test_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Reg Date|My Time|7|V x|Name\n2020-01-02|01:02:03|5|1.5|a\n2020-01-03|00:00:01|oops|x|b\n")
    rows = [r.asDict() for r in files.read_delimited(spark, str(path), "|").collect()]
    assert rows[0] == {"reg_date": 1577923200 * 10**9, "my_time": 3723 * 10**9, "col2": 5.0, "v_x": 1.5, "name": "a"}
    assert rows[1]["col2"] is None and rows[1]["v_x"] is None and rows[1]["name"] == "b"
    lost: dict = {}
    assert files.read_delimited(spark, str(path), "|", account=lost).schema["col2"].dataType.typeName() == "long" and lost == {"col2": 1, "v_x": 1}
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a").write_bytes(b"".join(struct.pack("<6q", 0, i, -i, 2, 3, 2**40) for i in range(100)))
    found = files.read_int64_records(spark, str(tmp_path / "bin"))
    assert found.columns == ["c0", "c1", "c2", "d0", "d1"] and found.agg(F.sum("c0"), F.min("c1"), F.max("d1")).first()[:] == (4950, -99, 2**40)
    split = files.read_int64_records(spark, f"file://{tmp_path}/bin", split_bytes=100)  # two records a split
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in found.collect()} and split.count() == 100
    (tmp_path / "bin" / "b").write_bytes(b"xyz")
    with pytest.raises(ValueError):
        files.read_int64_records(spark, str(tmp_path / "bin"))
    made = []
    assert files.load_once(spark, "once_probe", lambda: made.append(1) or spark.range(3)).count() == 3
    assert files.load_once(spark, "once_probe", lambda: made.append(1) or spark.range(4)).count() == 3 and made == [1]
    spark.sql("DROP TABLE once_probe")
    g = files.gaussian_table(spark, 5000, 3, seed=1)
    assert g.count() == 5000 and g.stat.corr("col0", "col1") > 0.05
    df = spark.createDataFrame([(1, "SELECT 1\nFROM t")], "id int, sql string")
    files.write_results(df, str(tmp_path / "r"))
    files.write_results(df, str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r")).count() == 2
    files.write_results(files.read_results(spark, str(tmp_path / "r")).limit(1), str(tmp_path / "r"), append=False)  # reads what it replaces
    assert files.read_results(spark, str(tmp_path / "r")).count() == 1
    files.write_results(df, str(tmp_path / "c"), "csv")
    files.write_results(df.select("id"), str(tmp_path / "c"), "csv", append=False)
    assert [tuple(r) for r in files.read_results(spark, str(tmp_path / "c"), "csv").collect()] == [(1,)]
    files.dump_sql(df, str(tmp_path / "sql"))
    assert spark.read.text(str(tmp_path / "sql")).first()[0] == "SELECT 1 FROM t"


def test_qerror_of_the_truth_is_one(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 7, 1e12)], "v double")
    assert all(r[0] == 1.0 for r in df.select(S.qerror(F.col("v"), F.col("v"))).collect())
    assert math.isclose(df.agg(F.max(S.log_denorm(S.log_norm(F.col("v"), 0.0, 30.0), 0.0, 30.0))).first()[0], 1e12, rel_tol=1e-9)


def test_walk_order():
    q = JoinQuery("w", {x: x for x in "abcd"}, (Edge("a", "k", "b", "k"), Edge("b", "k", "c", "k"), Edge("c", "k", "d", "k")))
    assert sampling.walk_order(q, {"b": 9, "d": 8, "c": 1, "a": 2}) == ["b", "a", "c", "d"]
    assert sampling.walk_order(q, {}) == ["a", "b", "c", "d"]


def test_experiment_table(spark):
    a, b = spark.createDataFrame([("x", 1.0)], "card string, loss double"), spark.createDataFrame([("y", 2.0)], "card string, loss double")
    found = {r.card: (r.experiment, r.rate, r.depth) for r in setops.experiment_table([(a, {"rate": 0.1}), (b, {"depth": 3})]).collect()}
    assert found == {"x": (0, "0.1", None), "y": (1, None, "3")}


def test_scratch_is_released(spark):
    from joinlens import session

    df = session.materialize(spark.range(5), "probe")
    path = df._scratch.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    session.release(df, spark.range(1))
    assert not os.path.exists(path)


def test_singular_values_by_group(spark):
    rng = random.Random(3)
    cells = [(g, r, f"c{c}", rng.random() + (c == 0) * r) for g, n in (("p", 6), ("q", 2)) for r in range(n) for c in range(3)]
    found = {}
    for r in models.singular_energy(spark.createDataFrame(cells, "g string, r int, c string, x double"), "g", "r", "c", "x").orderBy("g", "k").collect():
        found.setdefault(r.g, []).append(r.singular)
    for g, n in (("p", 6), ("q", 2)):
        m = np.array([x for gg, _, _, x in cells if gg == g]).reshape(n, 3)
        assert np.allclose(found[g], np.linalg.svd(m, compute_uv=False), atol=1e-6)


def test_planner_rows_and_spread(spark, tmp_path):
    from joinlens.session import spread

    spark.sql("CREATE TABLE IF NOT EXISTS stats_probe USING parquet AS SELECT id % 50 AS k FROM range(1000)")
    try:
        spark.sql("ANALYZE TABLE stats_probe COMPUTE STATISTICS FOR ALL COLUMNS")
        spark.conf.set("spark.sql.cbo.enabled", "true")
        assert stats.planner_rows(spark, "SELECT * FROM stats_probe WHERE k = 7") == 20
    finally:
        spark.conf.set("spark.sql.cbo.enabled", "false")
        spark.sql("DROP TABLE stats_probe")
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(small).collect()) == list(range(100))


def test_cross_joins_are_refused():
    q = JoinQuery("x", {"a": "x", "b": "y"}, ())
    with pytest.raises(ValueError, match="cross join"):
        q.join(lambda n: _Fake(), ("a", "b"))


class _Fake:
    def select(self, *_):
        return self

    def alias(self, _):
        return self
