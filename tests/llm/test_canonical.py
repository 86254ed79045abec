import random

import pytest

from joinlens.llm import canonical as C


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("SELECT COUNT(*) FROM title AS t, name AS n WHERE t.id = n.id", "select count(*)\nfrom name as n,title as t where n.id=t.id ;"),
        ("select count(*) from t where t.a in ('x', 'y')", 'SELECT COUNT(*) FROM t WHERE (t.a IN ("Y","x"))'),
        ("select count(*) from t where t.a < 5 and t.b = 'q'", "select count(*) from t where t.b = 'Q' and t.a < '5'"),
        ("select count(*) from t where (t.a in ('x') or t.a is null) and t.c between 1 and 2", "select count(*) from t where t.c between '1' and 2 and (t.a in ('x') or t.a is null)"),
        ("select count(*) from t where t.x = '-5'", "select count(*) from t where t.x = -5"),
        ("select count(*) from t where t.x in (-5, 3)", "select count(*) from t where t.x in ('3', '-5')"),
        ("select count(*) from t where t.x < '.5' and t.y > '1e3' and t.z = '2.5E-07'", "select count(*) from t where t.x < .5 and t.y > 1e3 and t.z = 2.5e-07"),
        ("select count(*) from t where t.x between -3 and -1", "select count(*) from t where t.x between '-3' and '-1'"),
        ("select count(*) from t where t.x = 'It''s'", 'select count(*) from t where t.x = "it\'s"'),
        ("select count(*) from t where lower(t.x) in ('b', 'a')", "select count(*) from t where LOWER( t.x ) in ('a', 'b')"),
        ("select count(*) from t where t.x::int in (2, 1)", "select count(*) from t where t.x::int in (1, '2')"),
        ("select count(*) from a, b where a.x = b.y", "select count(*) from b, a where (b.y) = a.x"),
        ("select count(*) from t where not t.x in (1, 2)", "select count(*) from t where not t.x in ('2', 1)"),
    ],
)
def test_same_query(a, b):
    assert C.canonical_query(a) == C.canonical_query(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("select count(*) from t where t.a < 5", "select count(*) from t where t.a <= 5"),
        ("select count(*) from t where t.a in ('x')", "select count(*) from t where t.a not in ('x')"),
        ("select count(*) from t where t.a in ('x')", "select count(*) from t where t.a = 'x'"),
        ("select count(*) from t where t.a like 'x%'", "select count(*) from t where t.a ilike 'x%'"),
        ("select count(*) from t where t.a = 1 or t.b = 2", "select count(*) from t where t.a = 1 and t.b = 2"),
        ("select count(*) from t where t.a between 1 and 2", "select count(*) from t where t.a between 2 and 1"),
        ("select count(*) from t as a where a.x is null", "select count(*) from t as b where b.x is null"),
        ("select count(*) from t where t.a < t.b", "select count(*) from t where t.b < t.a"),
        ("select count(*) from t where x = \"a' ; y = 'b\"", "select count(*) from t where x = 'a' and y = 'b'"),
        ("select count(*) from t where x in (\"a' , 'b\")", "select count(*) from t where x in ('a', 'b')"),
        ("select count(*) from t where x = '-5'", "select count(*) from t where x = 5"),
        ("select count(*) from t where a.x - 5 = 1", "select count(*) from t where a.x = 1 - 5"),
        ("select count(*) from t where t.x in (1, 2)", "select count(*) from t where not t.x in (1, 2)"),
        ("select count(*) from t where t.x = 1.0", "select count(*) from t where t.x = 1"),
    ],
)
def test_other_query(a, b):
    assert C.canonical_query(a) != C.canonical_query(b)


def test_odd_texts():
    assert C.canonical_query(None) is C.canonical_query("") is C.canonical_query(" \n;") is None
    assert C.canonical_query("not sql at all 'x") == C.canonical_query("NOT  sql AT all 'X")
    assert C.canonical_query("select a from t where (((")  # unbalanced text has a form too
    assert len(C.canonical_query("select a from t where " + " and ".join(f"t.c{i} = {i}" for i in range(20000)))) > 100_000


def test_copies_and_counts(spark):
    base = ["select count(*) from t where t.a = 1", "select count(*) from t where t.a = 2"]
    rows = [(9, base[0]), (3, base[0].upper()), (7, base[0] + " ;"), (1, base[1]), (2, None), (4, None), (5, ""), (9, base[0])]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in rows], "qid long, sql string, hash_lo string, n_copies int")
    hashed = C.with_query_hash(df, "sql", ["qid"])
    found = {(r.qid, r.copy_qid) for r in C.copies(hashed, "qid").collect()}
    assert found == {(3, 9), (3, 7)}
    classes = {r.qid: (r.n_copies, r.is_query) for r in C.collapse(hashed, "qid").collect()}
    assert classes == {3: (4, True), 1: (1, True), 2: (1, False), 4: (1, False), 5: (1, False)}
    assert C.copies(C.with_query_hash(df.limit(0), "sql", ["qid"]), "qid").count() == 0


def test_brute_force(spark):
    rng = random.Random(1)

    def write() -> tuple[tuple, str]:
        conditions = [(rng.choice("ab"), rng.choice(["=", "<"]), rng.randint(1, 3)) for _ in range(rng.randint(1, 3))]
        text = [f"t.{c}{rng.choice(['', ' '])}{o} {rng.choice(['', chr(39)])}" for c, o, _ in conditions]
        text = [x + f"{v}" + ("'" if x.endswith("'") else "") for x, (_, _, v) in zip(text, conditions)]
        text = [f"({x})" if rng.random() < 0.3 else x for x in text]
        return tuple(sorted(conditions)), rng.choice([str, str.upper])("select count(*) from t where " + " and ".join(text))

    made = [write() for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(made)], "qid long, sql string")
    first: dict = {}
    want = set()
    for i, (k, _) in enumerate(made):
        want |= {(first.setdefault(k, i), i)} if first.setdefault(k, i) != i else set()
    assert {tuple(r) for r in C.copies(C.with_query_hash(df, "sql", ["qid"]), "qid").collect()} == want


def test_collision_check(spark):
    df = spark.createDataFrame([(i, f"select {i} from t") for i in range(300)], "qid long, sql string")
    weak = C.with_query_hash(df, "sql", ["qid"], digest=1)  # one byte of hash: collisions are certain
    assert C.collapse(weak, "qid").count() <= 256
    strong = C.collapse(C.with_query_hash(df, "sql", ["qid"]), "qid")
    assert strong.count() == 300 and C.hash_collisions(strong).count() == 0
    assert C.account(strong).first().asDict() == {"n_rows": 300, "n_queries": 300, "n_surplus": 0, "n_without": 0, "n_collisions": 0}
    same = C.with_query_hash(df.unionByName(df), "sql", ["qid"]).selectExpr("qid", "0L AS hash_hi", "0L AS hash_lo", "hash_check")
    kept = C.collapse(same, "qid")  # the check keeps apart what the hash does not
    assert C.account(kept).first().asDict() == {"n_rows": 600, "n_queries": 300, "n_surplus": 300, "n_without": 0, "n_collisions": 300}
