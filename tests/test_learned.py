"""Features of stored sub-plans and the models that learn from them."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from data import PRESENT
from joinlens.operators import features as X
from joinlens.operators import models, pgm
from joinlens.plans import local, search


def workload(spark, n=400, seed=1):
    """Queries over two of four tables, whose sizes follow from table, join and filter."""
    rng = random.Random(seed)
    size = {"r": 10, "s": 1000, "t": 50, "u": 20_000}
    queries, plans, nodes, joins = [], [], [], []
    for qid in range(n):
        a, b = rng.sample(sorted(size), 2)
        low = rng.randint(0, 9)
        pattern = rng.choice(["x%", "%longer12%"])
        queries.append((qid, f"SELECT COUNT(*) FROM {a} AS a, {b} AS b WHERE a.k = b.k AND a.v > {low} AND a.v <= 10 AND b.w LIKE '{pattern}'"))
        nodes += [(qid, "a", a), (qid, "b", b)]
        joins.append((qid, "a", "b", f"{a}.k = {b}.k"))
        one, two = size[a] * (10 - low) / 10, size[b] * (0.5 if pattern == "x%" else 0.01)
        for subset, actual, total in (("a", one, size[a]), ("b", two, size[b]), ("a b", one * two / 5, size[a] * size[b] / 5)):
            plans.append((qid, subset, len(subset.split()), math.ceil(actual), int(total * rng.choice([0.02, 0.5, 1.0])) + 1, int(total), "train" if qid % 4 else "test"))
    return (
        spark.createDataFrame(plans, "qid long, subset string, n_tables int, actual long, expected long, total long, split string"),
        spark.createDataFrame(nodes, "qid long, alias string, real_name string"), spark.createDataFrame(joins, "qid long, a1 string, a2 string, join_condition string"),
        X.workload_filters(spark.createDataFrame(queries, "qid long, sql string"), "qid", "sql"),
    )


def test_filters_of_texts(spark):
    rows = [(1, "SELECT COUNT(*) FROM title AS t, x WHERE t.a > 3 AND t.a <= 9 AND t.b ILIKE '%q%' AND x.c = 'v' AND t.id = x.id"), (2, None), (3, "nonsense"), (4, "SELECT COUNT(*) FROM dmv WHERE c IN ('p', 'q') OR c IS NULL")]
    found = [tuple(r) for r in X.workload_filters(spark.createDataFrame(rows, "qid long, sql string"), "qid", "sql").orderBy("qid", "alias", "pos").collect()]
    assert found == [
        (1, "t", 0, "title.a", "lt", ["3", "9"]), (1, "t", 1, "title.b", "like", ["%q%"]), (1, "x", 0, "x.c", "eq", ["v"]),
        (4, "dmv", 0, "dmv.c", "in", ["p", "q"]), (4, "dmv", 1, "dmv.c", "in", ["NULL"]),
    ]
    stats = {r.col_name: (r.min_value, r.max_value, r.num_values) for r in X.filter_stats(X.workload_filters(spark.createDataFrame(rows, "qid long, sql string"), "qid", "sql")).collect()}
    assert stats["title.a"] == ("3.0", "9.0", 2) and stats["dmv.c"] == ("NULL", "q", 3)


def test_combined_vector_is_the_sum_of_its_parts(spark):
    plans, nodes, joins, filters = workload(spark, 40)
    sparse, width = X.combined(plans, nodes, joins, filters)
    rows = {(r.qid, r.subset): r.features for r in X.dense(sparse, width).collect()}
    assert len(rows) == plans.count() and {len(v) for v in rows.values()} == {width}
    tables = sorted({r.real_name for r in nodes.collect()})
    for (qid, subset), v in rows.items():
        assert sum(v[: len(tables)]) == len(subset.split())
        if subset == "a b":
            parts = np.array(rows[qid, "a"]) + np.array(rows[qid, "b"])
            n_joins = joins.select("join_condition").distinct().count()
            inner = [i for i in range(width - 4) if not len(tables) <= i < len(tables) + n_joins]
            assert np.allclose(np.array(v)[inner], parts[inner]) and sum(v[len(tables) : len(tables) + n_joins]) == 1
    ops = X.operator_features(filters).groupBy("slot").count().collect()
    assert {X.OPERATORS[r.slot] for r in ops} == {"lt", "like"} and all(r["count"] == 40 for r in ops)


def test_slopes_of_the_network():
    rng = np.random.default_rng(0)
    widths = {"tables": 3, "joins": 2, "columns": 2, "operators": 2, "hashes": 2, "scalars": 2}
    net = models.SetNetwork(widths, hidden=5, seed=1)
    table = pa.table({
        "tables": pa.array([[0, 2], [1], [], None], pa.list_(pa.int32())), "joins": pa.array([[0], None, [1], [0, 1]], pa.list_(pa.int32())),
        "filters": pa.array([[{"c": 1, "o": 0, "h": 1, "lo": 0.2, "hi": 0.7}], None, [], [{"c": 0, "o": 1, "h": 0, "lo": 0.0, "hi": 1.0}] * 2],
                            pa.list_(pa.struct([("c", pa.int32()), ("o", pa.int32()), ("h", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))),
        "scalars": pa.array([[0.1, 0.5], [0.2, 0.1], [0.9, 0.3], [0.4, 0.4]], pa.list_(pa.float64())),
    })
    parts = [(x.astype(float), mask.astype(float)) for x, mask in net.tensors(table)]
    assert [int(m.sum()) for _, m in parts[:3]] == [3, 4, 3]
    net.w = [w + rng.normal(0, 0.1, w.shape) for w in net.w]
    y = np.array([1.0, 3.0, 0.5, 2.0])
    value = {"mse": lambda d: d**2, "abs": np.abs, "qloss": lambda d: np.exp(np.abs(d)), "rel": lambda d: np.abs(np.exp(d) - 1), "weighted": lambda d: np.exp(np.abs(d)) + np.abs(np.exp(d) - 1)}
    for kind, f in value.items():
        out, kept = net.forward(parts)
        slopes = net.slopes(kept, models.loss_slope(kind, out - y) / len(y))
        for i in range(len(net.w)):
            at = tuple(rng.integers(0, n) for n in net.w[i].shape)
            old, losses = net.w[i][at], []
            for step in (1e-6, -1e-6):
                net.w[i][at] = old + step
                losses.append(f(net.forward(parts)[0] - y).mean())
            net.w[i][at] = old
            assert slopes[i][at] == pytest.approx((losses[0] - losses[1]) / 2e-6, rel=1e-3, abs=1e-6)


def median_q(rows, name):
    return np.median([max(max(r.actual, 1) / max(r[name], 1), max(r[name], 1) / max(r.actual, 1)) for r in rows])


def test_models_learn_what_the_planner_misses(spark):
    plans, nodes, joins, filters = workload(spark)
    sparse, width = X.combined(plans, nodes, joins, filters)
    rows = X.dense(sparse, width).join(plans.select("qid", "subset", "split", "actual", "expected"), ["qid", "subset"])
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    found = models.fit_predict(train, test, ["features"], "actual", "rf").collect()
    assert median_q(found, "est") < 0.7 * median_q(found, "expected")
    sets, widths = X.set_features(plans, nodes, joins, filters)
    both = sets.join(plans.select("qid", "subset", "split", "actual", "expected"), ["qid", "subset"])
    for loss in ("mse", "qloss"):
        found = models.network_predict(both.where("split = 'train'"), both.where("split = 'test'"), widths, "actual", ["qid", "subset", "actual", "expected"], loss).collect()
        assert len(found) == 300 and median_q(found, "est") < 0.5 * median_q(found, "expected")


@pytest.mark.skipif(not PRESENT, reason="no test tables")
@pytest.mark.parametrize("name", ["linear_estimator", "network_estimator"])
def test_models_beat_the_stored_planner(spark, name):
    found = entry.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert len(found) > 900 and median_q(found, "est") < median_q(found, "expected")


def test_pairwise_model_of_two_columns_is_exact(spark):
    rng = random.Random(2)
    rows = [(a := rng.choice("pqr"), rng.choice("xy" if a == "p" else "xyz"), rng.choice("12")) for _ in range(500)]
    freq = pgm.frequency(spark.createDataFrame(rows, "b string, a string, c string"), ["b", "a", "c"])
    marginal, joint = pgm.marginals(freq, ["b", "a", "c"]), pgm.joints(freq, ["b", "a", "c"])
    points = spark.createDataFrame([(i, c, v) for i, (b, a) in enumerate((b, a) for b in "pqr" for a in "xyz") for c, v in (("b", b), ("a", a))] + [(99, "a", "unseen"), (99, "b", "p")], "qid int, col_name string, value string")
    found = {r.qid: r.p for r in pgm.pairwise(pgm.corrections(joint, marginal, 5), marginal, [("b", "a")], points).collect()}
    for i, (b, a) in enumerate((b, a) for b in "pqr" for a in "xyz"):
        assert found[i] == pytest.approx(sum(r[0] == b and r[1] == a for r in rows) / 500, abs=1e-9)
    assert found[99] == 0


def test_blame_goes_down_the_plan(spark):
    """a b c d: the estimate errs only below a b c, so the blame goes there; then only at the top, so all are blamed."""

    def edges(true):
        chain = [("a b", "a", "b"), ("a c", "a", "c"), ("a b c", "a b", "c"), ("a b c", "a c", "b"), ("a b c d", "a b c", "d")]
        est = {"a b|a": 1.0, "a c|a": 5.0, "a b c|a b": 1.0, "a b c|a c": 1.0, "a b c d|a b c": 1.0}
        return spark.createDataFrame([("q", b, s, o, true[f"{b}|{s}"], est[f"{b}|{s}"]) for b, s, o in chain], "qid string, big string, small string, other string, true double, est double")

    below = edges({"a b|a": 100.0, "a c|a": 1.0, "a b c|a b": 1.0, "a b c|a c": 1.0, "a b c d|a b c": 1.0})
    found = {r.subset: r.priority for r in search.subquery_priorities(below, "true", "est", scale=1.0).collect()}
    assert found["a b c d"] == 99 and found["a b c"] == found["a"] == found["a c"] == 198 and found["d"] == 99 if "d" in found else True
    none = edges({"a b|a": 1.0, "a c|a": 5.0, "a b c|a b": 1.0, "a b c|a c": 1.0, "a b c d|a b c": 1.0})
    assert {r.priority for r in search.subquery_priorities(none, "true", "est").collect()} == {0.0}
    weights = search.query_weights(spark.createDataFrame([("q", 5e6, 1.5), ("r", -1.0, 1.0)], "qid string, loss double, ratio double"), spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "qid string, subset string"), "loss", True)
    assert {tuple(r) for r in weights.collect()} == {("q", "a", 2.5), ("q", "b", 2.5), ("r", "a", 0.0)}


def test_queries_pass_one_by_one(spark):
    df = spark.createDataFrame([(q, i) for q in "abc" for i in range(700)] + [(None, 1), (None, 2)], "qid string, v int")
    found = {r.qid: (r.n, r.s) for r in local.per_query(df.select("qid", "v"), ["v"], lambda v: [(len(v), sum(v))], "n int, s int").collect()}
    assert found == {q: (700, sum(range(700))) for q in "abc"} | {None: (2, 3)}
    assert local.per_query(df.limit(0), ["v"], lambda v: [(len(v),)], "n int").count() == 0
    assert df.select(F.count("v")).first()[0] == 2102
