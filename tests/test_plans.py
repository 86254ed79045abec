import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinlens.operators import cards, replay, stats
from joinlens.plans import costs, edges, flow, search
from joinlens.workload import catalog as C
from joinlens.workload.spec import Edge, JoinQuery, Predicate, key


def chain(n):
    names = "abcdefgh"[:n]
    return JoinQuery("chain", {x: f"t{x}" for x in names}, tuple(Edge(x, "k", y, "k") for x, y in zip(names, names[1:])))


def test_subset_counts():
    assert [len(chain(n).subsets()) for n in (1, 3, 5)] == [1, 6, 15]
    assert [len(q.subsets()) for q in (C.G3, C.G5, C.G6, C.G7)] == [6, 15, 24, 50]
    star = JoinQuery("star", {x: x for x in "habc"}, tuple(Edge("h", "k", x, "k") for x in "abc"))
    assert len(star.subsets()) == 2**3 + 3
    assert key(("b", "a")) == "a b"


def test_hub_alone_does_not_connect():
    assert not C.HUB.connected({"c", "n", "s"}) and C.HUB.connected({"c", "n"}) and not C.HUB.connected({"c", "s"})


def test_batch_enumeration(spark):
    links = spark.createDataFrame([(q.qid, e.a, e.b) for q in C.ALL for e in q.edges], "qid string, a string, b string")
    nodes = spark.createDataFrame([(q.qid, a) for q in C.ALL for a in q.tables], "qid string, alias string")
    found = {tuple(r) for r in edges.connected_subsets(links, nodes).collect()}
    assert found == {(q.qid, key(s), len(s)) for q in C.ALL for s in q.subsets()}


def random_tables(spark, seed):
    rng = random.Random(seed)

    def one(n):
        return spark.createDataFrame([(rng.choice([None, *range(6)]), rng.choice([None, *range(4)]), rng.randint(0, 9)) for _ in range(n)], "k int, j int, v int")

    made = {t: one(rng.randint(0, 40)) for t in ("x", "y", "z")}
    return lambda name: made[name], made


QUERIES = [
    JoinQuery("tree", {"a": "x", "b": "y", "c": "z", "d": "x"}, (Edge("a", "k", "b", "k"), Edge("b", "j", "c", "j"), Edge("b", "k", "d", "k")), {"a": (Predicate("v", "range", (2, None)),)}),
    JoinQuery("cycle", {"a": "x", "b": "y", "c": "z"}, (Edge("a", "k", "b", "k"), Edge("b", "j", "c", "j"), Edge("a", "j", "c", "k")), {"c": (Predicate("v", "in", (1, 2, 3, 4)),)}),
    JoinQuery("unequal", {"a": "x", "b": "y", "c": "x"}, (Edge("a", "k", "b", "k"), Edge("b", "j", "c", "j", "!="))),
    JoinQuery("both", {"a": "x", "b": "x"}, (Edge("a", "k", "b", "k"), Edge("a", "v", "b", "v", "!="))),
]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.qid)
@pytest.mark.parametrize("seed", [1, 2])
def test_shared_counts_equal_brute_force(spark, query, seed):
    load, tables = random_tables(spark, seed)
    rows = {t: [r.asDict() for r in df.collect()] for t, df in tables.items()}

    def keep(alias, r):
        for p in query.preds.get(alias, ()):
            v = r[p.column]
            if p.op == "range" and not (p.values[0] is None or v > p.values[0]):
                return False
            if p.op == "in" and v not in p.values:
                return False
        return True

    def brute(s):
        n = 0
        for combo in itertools.product(*([r for r in rows[query.tables[a]] if keep(a, r)] for a in s)):
            at = dict(zip(s, combo))
            good = True
            for e in query.edges:
                if e.a in at and e.b in at:
                    x, y = at[e.a][e.ca], at[e.b][e.cb]
                    good &= x is not None and y is not None and ((x == y) if e.op == "=" else (x != y))
            n += good
        return n

    want = {key(s): brute(s) for s in query.subsets()}
    got = {r.subset: r.value for r in cards.sub_plan_counts(spark, load, query).collect()}
    assert got == want


EDGES = "qid string, big string, small string, other string, cost double, est double"


def graph(spark, seed=0, qid="q"):
    rng = random.Random(seed)
    q = JoinQuery(qid, {x: x for x in "abcd"}, (Edge("a", "k", "b", "k"), Edge("b", "k", "c", "k"), Edge("c", "k", "d", "k"), Edge("a", "k", "d", "k")))
    subsets = set(q.subsets())
    return [(qid, key(b), key(s), a, float(rng.randint(1, 30)), float(rng.randint(1, 30))) for b in sorted(subsets) for a in b if (s := tuple(x for x in b if x != a)) in subsets]


def brute_plans(rows):
    """(cost, est, order) of every left-deep order."""
    by = {(r[1], r[3]): (r[4], r[5]) for r in rows}
    for order in itertools.permutations("abcd"):
        cost = est = 0.0
        for n in range(2, 5):
            step = by.get((key(tuple(sorted(order[:n]))), order[n - 1]))
            if step is None:
                break
            cost, est = cost + step[0], est + step[1]
        else:
            yield cost, est, " ".join(order)


@pytest.mark.parametrize("seed", range(3))
def test_plan_search_and_loss(spark, seed):
    rows = graph(spark, seed)
    df = spark.createDataFrame(rows, EDGES)
    plans = list(brute_plans(rows))
    best = search.left_deep(df, "cost", full=True).first()
    assert best.best == min(p[0] for p in plans) and any(p[0] == best.best and p[2] == best.path for p in plans)
    loss = search.plan_loss(df, "cost", "est").first()
    chosen = [p for p in plans if p[1] == min(q[1] for q in plans)]
    assert loss.best_cost == best.best and loss.est_plan_cost in {p[0] for p in chosen} and loss.loss >= 0
    assert search.plan_loss(df, "cost", "cost").first().loss == 0


def test_two_queries_at_once(spark):
    rows = graph(spark, 1, "p") + graph(spark, 2, "q")
    both = {r.qid: r.best for r in search.left_deep(spark.createDataFrame(rows, EDGES), "cost", full=True).collect()}
    assert both == {x: min(p[0] for p in brute_plans([r for r in rows if r[0] == x])) for x in "pq"}


def test_ties_go_to_the_first_name(spark):
    rows = [(r[0], r[1], r[2], r[3], 1.0, 1.0) for r in graph(spark)]
    assert search.left_deep(spark.createDataFrame(rows, EDGES), "cost", full=True).first().path == "a b c d"


def test_flow_is_conserved(spark):
    df = spark.createDataFrame(graph(spark, 5), EDGES)
    found = flow.flows(df, "est", "cost").collect()
    into, out = {}, {}
    for r in found:
        out[r.big] = out.get(r.big, 0) + r.flow
        into[r.small] = into.get(r.small, 0) + r.flow
    assert out["a b c d"] == pytest.approx(1) and into["s0"] == pytest.approx(1)
    assert all(into[n] == pytest.approx(out[n]) for n in out if n != "a b c d")
    assert {r.subset: r.importance for r in flow.node_importance(flow.flows(df, "est", "cost")).collect()}["a b c d"] == 1


def test_flow_gradient(spark):
    rows = graph(spark, 6)

    def loss(rows):
        return flow.flow_loss(flow.flows(spark.createDataFrame(rows, EDGES), "est", "cost")).first().flow_loss

    step, at = 1e-4, 3
    grads = {(r.big, r.small): r.gradient for r in flow.gradients(spark.createDataFrame(rows, EDGES), "est", "cost").collect()}
    up, down = list(rows), list(rows)
    up[at], down[at] = (*rows[at][:5], rows[at][5] + step), (*rows[at][:5], rows[at][5] - step)
    assert grads[rows[at][1], rows[at][2]] == pytest.approx((loss(up) - loss(down)) / (2 * step), rel=1e-3)


def test_flow_gradient_by_count(spark):
    rng = random.Random(4)
    links = [("a b", "a", "b"), ("a c", "a", "c"), ("a b c", "a b", "c"), ("a b c", "a c", "b")]
    cards = {s: rng.uniform(5, 500) for s in ("a", "b", "c", "a b", "a c", "a b c")}

    def edges_of(cards):
        rows = [("q", b, s, o, cards[s], cards[o], cards[b], 900.0, 900.0) for b, s, o in links]
        return spark.createDataFrame(rows, "qid string, big string, small string, other string, c1 double, c2 double, c3 double, t1 double, t2 double")

    truth = {(b, s): rng.uniform(1, 50) for b, s, _ in links}
    true = spark.createDataFrame([("q", b, s, c) for (b, s), c in truth.items()], "qid string, big string, small string, true double")

    def both(cards):
        return costs.with_cost(edges_of(cards), "nested_loop_index9", "est").join(true, ["qid", "big", "small"])

    def loss(cards):
        return flow.flow_loss(flow.flows(both(cards), "est", "true")).first().flow_loss

    found = {r.subset: r.gradient for r in flow.card_gradients(edges_of(cards), flow.gradients(both(cards), "est", "true"), costs.MODELS["nested_loop_index9"]).collect()}
    for s in ("a", "a b", "a b c"):
        up, down = (loss(cards | {s: cards[s] * float(np.exp(h))}) for h in (1e-4, -1e-4))
        assert found[s] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-6)


def test_replay(spark):
    queries = spark.createDataFrame([("a", "SELECT 1"), ("a", "SELECT 1"), ("b", "SELECT * FROM gone"), ("c", "SELECT sum(id % 7 + hash(id)) FROM range(100000000000)"), ("known", "SELECT 2")], "sql_key string, sql string")
    rows = {(r.sql_key, r.repetition): r for r in replay.replay(spark, queries, spark.createDataFrame([("known",)], "sql_key string"), repetitions=2, timeout_ms=1500).collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("b", 0), ("c", 0)}
    assert rows["a", 1].status == "ok" and rows["a", 1].n_rows == 1 and rows["b", 0].status == "exception" and (rows["c", 0].status, rows["c", 0].runtime) == ("timeout", 10.5)


def test_physical_joins(spark):
    spark.range(50).createOrReplaceTempView("left_side")
    joined = stats.physical_joins(spark, "SELECT /*+ MERGE(b) */ * FROM left_side a JOIN left_side b ON a.id = b.id JOIN left_side c ON b.id < c.id")
    assert {tuple(r) for r in joined.collect()} == {("SortMergeJoin", "merge"), ("BroadcastNestedLoopJoin", "nested")}


def test_costs_and_hints(spark):
    df = spark.createDataFrame([("a b", "a", "b", 10.0, 200.0, 50.0, 100.0, 400.0), ("a b c", "a b", "c", 50.0, 4.0, 20.0, 1.0, 8.0)], "big string, small string, other string, c1 double, c2 double, c3 double, t1 double, t2 double")
    got = {m: [round(r.cost, 6) for r in costs.with_cost(df, m).collect()] for m in ("cm1", "nested_loop_index7", "nested_loop_index5", "nested_loop_index9", "nested_loop")}
    assert got["cm1"] == [200.01, 50.004] and got["nested_loop_index7"] == [200.01, 50.004]
    assert got["nested_loop_index5"] == [400.0, 200.0] and got["nested_loop_index9"] == [700.0, 90.0] and got["nested_loop"] == [2000.0, 200.0]
    with pytest.raises(ValueError):
        costs.with_cost(df, "unknown")
    assert spark.range(1).select(search.leading_hint(F.lit("a b c d"))).first()[0] == "(((a b) c) d)"


def test_timeout_and_cache(spark, tmp_path):
    assert cards.execute(spark, "SELECT count(*) FROM range(10)")[1][0][0] == 10
    cache = cards.CountCache(spark, str(tmp_path / "c"), threshold=0.0)
    assert cache.get("SELECT count(*) FROM range(7)") == 7 == cache.get("SELECT count(*) FROM range(7)")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    status, _ = cards.execute(spark, "SELECT count(*) FROM range(400000) a JOIN range(400000) b ON a.id % 3 = b.id % 3 AND a.id < b.id", timeout=1.0)
    assert status == cards.TIMEOUT


def test_network_shapes():
    big, small = np.array(["a b", "a b", "a", "b"]), np.array(["a", "b", "s0", "s0"])
    f, _ = flow.solve(big, small, np.array([1.0, 3.0, 1.0, 1.0]))
    assert f[0] == pytest.approx(2 / 3) and f[1] == pytest.approx(1 / 3)
