import random

import pytest

from joinlens.operators import cards, labelling
from joinlens.workload import parser
from joinlens.workload.spec import Edge, JoinQuery, key

FILTERS = {
    "a": ["a.v > 3", "a.v >= 3", "a.v < 7", "a.v <= 7", "a.v BETWEEN 2 AND 6", "a.v NOT BETWEEN 2 AND 6", "a.v = 4", "a.v != 4", "a.v <> 4", "a.v IN (1, 2, '5')", "a.v NOT IN (1, 2)", "a.v IS NULL", "a.v IS NOT NULL", "a.v = -1",
          "(a.v < 2 OR a.v > 7)", "(a.v = 1 OR a.v = 2 AND a.w = 'x')", "(a.v = 1 OR (a.v > 2 AND (a.w = 'y' OR a.w IS NULL)))", "NOT a.v = 3", "NOT (a.w LIKE 'x%')", "a.v < a.k", "5 > a.v", "(a.v) = 2", "a.v > 1.5"],
    "b": ["b.w LIKE 'x%'", "b.w NOT LIKE '%z'", "b.w ILIKE '%X%'", "b.w NOT ILIKE 'X%'", "b.w = 'it''s'", "b.w IN ('xz', 'y', 'it''s')", "b.k >= 2 AND b.k < 5", "b.w IS NULL"],
}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    x = [(rng.choice([None, *range(6)]), rng.choice([None, *range(-1, 10)]), rng.choice([None, "x", "y", "xy"])) for _ in range(120)]
    y = [(rng.choice([None, *range(6)]), rng.choice([None, "xz", "X", "y", "it's", "zz"])) for _ in range(90)]
    made = {"x": spark.createDataFrame(x, "k int, v int, w string"), "y": spark.createDataFrame(y, "k int, w string")}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return made


def texts():
    out = [f"SELECT COUNT(*) FROM x AS a WHERE {f}" for f in FILTERS["a"]]
    out += [f"SELECT COUNT(*) FROM x AS a, y b WHERE a.k = b.k AND {f} AND {FILTERS['a'][i % 20]};" for i, f in enumerate(FILTERS["b"])]
    out += ["select count(*) from x as a, y as b where a.k != b.k and a.v > 3", "SELECT COUNT(*) FROM x AS a, x AS c, y AS b WHERE a.k = b.k AND c.k = b.k AND a.k = c.k AND c.v < 5"]
    return out


@pytest.mark.parametrize("sql", texts())
def test_original_and_rebuilt_text_agree(spark, tables, sql):
    q = parser.to_query(sql, "q")
    want = spark.sql(sql.rstrip(";")).first()[0]
    assert spark.sql(q.count_sql()).first()[0] == want
    load = tables.__getitem__
    assert (q.join(load, tuple(q.tables)).count() if len(q.tables) > 1 else q.base(load, "a").count()) == want


def test_filters_keep_their_meaning():
    def where(sql):
        return parser.to_query("SELECT COUNT(*) FROM t WHERE " + sql, "q").count_sql().split(" WHERE ")[1]

    assert where("a >= 10 AND a <= 20") == "t.a <= 20 AND t.a >= 10"
    assert where("a = 1 OR b = '2'") == "(t.a = 1 OR t.b = '2')"
    assert where("a IS NOT NULL") == "t.a IS NOT NULL" and where("a IS NULL") == "t.a IS NULL"
    assert where("a NOT IN (-5, 'x')") == "t.a NOT IN (-5, 'x')"
    assert where("a ILIKE 'x'") == "t.a ILIKE 'x'" and where('a = "it\'s"') == "t.a = 'it''s'"
    assert where(r"a ~ '^(?:[1-9]\d*|0)?(?:\.\d+)?$' AND a::float <= 5") == "TRY_CAST(t.a AS DOUBLE) <= 5"
    assert where("a ~ '^x'") == "regexp_like(t.a, '^x')"
    assert where("a = 1e3 AND a < .5") == "t.a < 0.5 AND t.a = 1000.0"


@pytest.mark.parametrize("sql", [
    "SELECT COUNT(*) FROM t AS a, u AS b WHERE a.x < b.y", "SELECT COUNT(*) FROM t AS a, u AS b WHERE (a.x = 1 OR b.y = 2)", "SELECT COUNT(*) FROM t AS a, u AS b WHERE (a.x = b.y OR a.x = 1)",
    "SELECT COUNT(*) FROM t AS a, u AS b WHERE x = 1", "SELECT COUNT(*) FROM t WHERE lower(a) = 'x'", "SELECT COUNT(*) FROM t WHERE a + 1 = 2", "SELECT a FROM t GROUP BY a", "SELECT COUNT(*) FROM t WHERE a IN (SELECT 1)",
    "SELECT COUNT(*) FROM t AS a, u AS a WHERE a.x = 1", "SELECT COUNT(*) FROM t WHERE c.x = 1", "SELECT COUNT(*) FROM t WHERE NOT (a = 1 AND b = 2)", "SELECT COUNT(*) FROM t WHERE 1 = 1", "SELECT COUNT(*) FROM t WHERE", "x", "SELECT COUNT(*) FROM t AS a WHERE a.x = 1 OR",
])
def test_what_cannot_be_said_is_refused(sql):
    with pytest.raises(parser.UnsupportedQuery):
        parser.to_query(sql, "q")


def test_statements_are_cut_outside_quotes():
    assert parser.split_statements("use a; SELECT 'x;y' FROM t; SET z = 1;\n select \";\" from u") == ["SELECT 'x;y' FROM t", 'select ";" from u']


def brute(spark, sql):
    q = parser.to_query(sql, "")
    return {key(s): spark.sql(q.count_sql(s)).first()[0] for s in q.subsets()}


def test_workload_counts(spark, tables, tmp_path):
    good = texts()
    rows = [(s,) for s in [*good, good[0], None, "SELECT COUNT(*) FROM gone AS g WHERE g.a = 1", "nonsense", "SELECT COUNT(*) FROM x AS a, y AS b WHERE a.v = 1"]]
    found = labelling.read_texts(spark.createDataFrame(rows, "sql string"), "sql", {"x", "y"})
    cache = f"file://{tmp_path}/cache"
    labels = labelling.label_workload(spark, tables.__getitem__, found, batch=5, cache=cache)
    by = {}
    for r in labels.join(found.select("sql_key", "sql"), "sql_key").collect():
        by.setdefault(r.sql, {})[r.subset] = (r.value, r.status)
    for sql in good:
        assert by[sql] == {s: (n, "ok") for s, n in brute(spark, sql).items()}
    assert by["nonsense"] == {None: (None, "unsupported")} and by["SELECT COUNT(*) FROM gone AS g WHERE g.a = 1"] == {None: (None, "missing_table")}
    assert by["SELECT COUNT(*) FROM x AS a, y AS b WHERE a.v = 1"]["a b"] == (None, "cross_join")

    def never(name):
        raise AssertionError(name)

    again = labelling.label_workload(spark, never, found, cache=cache)  # all known: no table is read
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in labels.collect()}
    full = labelling.label_workload(spark, tables.__getitem__, found, skip_zero=True, cache=cache)
    assert full.where("value = 0").count() == 0
    assert labelling.label_workload(spark, tables.__getitem__, found.limit(0)).count() == 0


def test_a_batch_that_takes_too_long(spark, tables, monkeypatch):
    sql = ["SELECT COUNT(*) FROM x AS a WHERE a.v = 1", "SELECT COUNT(*) FROM x AS a WHERE a.v = 2"]
    found = labelling.read_texts(spark.createDataFrame([(s,) for s in sql], "sql string"), "sql", {"x"})
    real = cards.within

    def slow(spark_, work, timeout, label=""):
        if label in ("labels part=0", "labels part=0-1"):
            return cards.TIMEOUT, None
        return real(spark_, work, timeout, label)

    monkeypatch.setattr(cards, "within", slow)
    states = sorted((r.status, r.value is None) for r in labelling.label_workload(spark, tables.__getitem__, found).collect())
    assert states == [("ok", False), ("timeout", True)]
    monkeypatch.undo()
    assert cards.within(spark, lambda: spark.range(10**11).selectExpr("sum(id % 7 + hash(id))").collect(), 1.0)[0] == cards.TIMEOUT


def test_members_of_a_batch_share_a_forest(spark, tables):
    shape = {"a": "x", "b": "y", "c": "x"}
    edges = (Edge("a", "k", "b", "k"), Edge("b", "k", "c", "k"))
    members = [JoinQuery(str(i), shape, edges, parser.to_query(f"SELECT COUNT(*) FROM x AS a, y AS b, x AS c WHERE a.v > {i} AND c.v < {7 - i}", "").preds if i else {}) for i in range(5)]
    got = {(r.sql_key, r.subset): r.value for r in labelling.count_batch(spark, tables.__getitem__, members).collect()}
    for m in members:
        for s in m.subsets():
            assert got[m.qid, key(s)] == spark.sql(m.count_sql(s)).first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_cycles_are_counted_without_joins(spark, seed, monkeypatch):
    """Triangles, squares and doubled conditions, with tails; filters and nulls; alone, with totals and in batches."""
    rng = random.Random(seed)
    data = {n: spark.createDataFrame([tuple(rng.choice([None, 0, 1, 2, 3]) for _ in range(3)) for _ in range(25)], "k int, j int, v int") for n in "wxyz"}
    shapes = [
        (("a", "k", "b", "k"), ("b", "k", "c", "k"), ("a", "k", "c", "k")),
        (("a", "k", "b", "k"), ("b", "j", "c", "k"), ("c", "j", "d", "k"), ("d", "j", "a", "j")),
        (("a", "k", "b", "k"), ("a", "j", "b", "j"), ("b", "j", "c", "k"), ("c", "j", "d", "j")),
        (("a", "k", "b", "k"), ("b", "k", "c", "j"), ("a", "v", "c", "k"), ("c", "j", "d", "k")),
    ]
    edges = tuple(Edge(*e) for e in shapes[seed])
    names = sorted({x for e in edges for x in (e.a, e.b)})
    q = JoinQuery("q", dict(zip(names, "wxyz")), edges, {"a": parser.to_query("SELECT COUNT(*) FROM w AS a WHERE a.v > 0", "").preds["a"]})
    want = {key(s): q.join(data.__getitem__, s).count() for s in q.subsets()}
    bare = {key(s): q.join(data.__getitem__, s, filters=False).count() for s in q.subsets()}

    def never(*_, **__):
        raise AssertionError("joined")

    monkeypatch.setattr(JoinQuery, "join", never)
    assert {r.subset: r.value for r in cards.sub_plan_counts(spark, data.__getitem__, q).collect()} == want
    assert {r.subset: (r.actual, r.total) for r in cards.actual_and_total(spark, data.__getitem__, q).collect()} == {s: (want[s], bare[s]) for s in want}
    members = [q, JoinQuery("r", q.tables, edges)]
    got = {(r.sql_key, r.subset): r.value for r in labelling.count_batch(spark, data.__getitem__, members).collect()}
    assert got == {("q", s): n for s, n in want.items()} | {("r", s): n for s, n in bare.items()}
