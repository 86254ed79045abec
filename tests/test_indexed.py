import random

import duckdb
import pytest

from joinlens.operators import labelling
from joinlens.operators.indexed import Index
from joinlens.workload import parser
from joinlens.workload.spec import key

OF_X = ["v > 3", "v >= 3 AND v < 7", "v BETWEEN 2 AND 6", "v BETWEEN 6 AND 2", "v NOT BETWEEN 2 AND 6", "v = 4", "v != 4", "v IN (1, 2, '5')", "v NOT IN (1, 2)", "v IS NULL", "v IS NOT NULL", "v = -1 AND k <= 3", "(v < 2 OR v > 7)", "(v = 1 OR v = 2 AND w = 'x')",
        "(v = 1 OR (v > 2 AND (w = 'y' OR w IS NULL)))", "NOT v = 3", "v > 99", "v < 9000000000", "NOT (w LIKE 'x%')", "(w IN ('x', 'a\nb') OR w IS NULL) AND v > 0 AND k < 5"]
OF_Y = ["w LIKE 'x%'", "w NOT LIKE '%z'", "w LIKE '%'", "w LIKE 'a_b'", "w LIKE '_'", "w LIKE '%.%'", "w ILIKE '%X%'", "w NOT ILIKE 'X%'", "w ILIKE '%.B'", "w = 'it''s'", "w IN ('xz', 'é', 'it''s')", "k >= 2 AND k < 5", "w IS NULL", "w > 'x'", "w <= 'X' AND k != 0"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    x = [(rng.choice([None, *range(6)]), rng.choice([None, *range(-1, 10)]), rng.choice([None, "x", "y", "xy", "a\nb"])) for _ in range(150)]
    y = [(rng.choice([None, *range(6), 9]), rng.choice([None, "xz", "X", "y", "it's", "zz", "é", "É", "a\nb", "a.b", "", "\U0001f600"])) for _ in range(60)]
    many = [(rng.choice([0, 0, 0, 1, 2]), i % 7) for i in range(400)]
    return {"x": spark.createDataFrame(x, "k int, v bigint, w string"), "y": spark.createDataFrame(y, "k int, w string"), "m": spark.createDataFrame(many, "k int, v int")}


def of(alias, filters):
    return parser.re.sub(r"\b([vkw])\b(?! ?')(?=\s*(?:[<>=!]|IN|NOT|BETWEEN|IS|LIKE|ILIKE))", rf"{alias}.\1", filters)


def labelled(spark, tables, sql, **more):
    found = labelling.read_texts(spark.createDataFrame([(s,) for s in sql], "sql string"), "sql", set(tables))
    out = {}
    for r in labelling.label_workload(spark, tables.__getitem__, found, **more).join(found.select("sql_key", "sql"), "sql_key").collect():
        assert out.setdefault(r.sql, {}).setdefault(r.subset, (r.value, r.status)) == (r.value, r.status)
    return out


def brute(tables, sql):
    db = duckdb.connect()
    for name, df in tables.items():
        db.register(name, df.toArrow())
    each = {s: parser.to_query(s, "") for s in sql}
    return {s: {key(sub): (db.sql(q.count_sql(sub)).fetchall()[0][0], "ok") for sub in q.subsets()} for s, q in each.items()}


def test_a_large_workload_needs_no_pass_a_batch(spark, tables, monkeypatch):
    """Every kind of filter, alone and joined, conditions written either way, rare aliases beside common ones."""
    sql = [f"SELECT COUNT(*) FROM x AS a WHERE {of('a', f)}" for f in OF_X]
    for i, f in enumerate(OF_Y):
        on = ("a.k = b.k", "b.k = a.k")[i % 2]
        sql += [f"SELECT COUNT(*) FROM x AS a, y AS b WHERE {on} AND {of('b', f)} AND {of('a', OF_X[(i * 7 + j) % len(OF_X)])}" for j in range(2)]
    sql += ["SELECT COUNT(*) FROM x AS a, y AS b WHERE a.k = b.k", "SELECT COUNT(*) FROM x AS c, y AS d WHERE d.k = c.k AND d.w LIKE 'x%' AND c.v > 3", "SELECT COUNT(*) FROM y AS z WHERE z.w IS NOT NULL"]
    want = brute(tables, sql)

    def never(*_, **__):
        raise AssertionError("a pass for a batch")

    monkeypatch.setattr(labelling, "count_batch", never)
    assert labelled(spark, tables, sql, batch=4) == want


def test_what_the_index_does_not_take_is_counted_by_messages(spark, tables):
    """Other kinds of filters, joins that are much larger than their tables, blocks that take too long."""
    sql = [f"SELECT COUNT(*) FROM x AS a, y AS b WHERE a.k = b.k AND {f}" for f in ("a.v < a.k", "a.v > 1.5", "a.v = 2", "b.w ILIKE '%É%'", r"b.w LIKE 'a\_b'")]
    wide = [f"SELECT COUNT(*) FROM m AS p, m AS q WHERE p.k = q.k AND p.v = {i}" for i in range(3)]
    index = Index(spark, tables.__getitem__)
    for text in (sql[0], wide[0]):
        index.learn(parser.to_query(text, ""))
    assert [index.takes(parser.to_query(s, "")) for s in sql + wide] == [False, False, True, False, False, False, False, False]
    assert labelled(spark, tables, sql[:4] + wide, batch=1) == brute(tables, sql[:4] + wide)


def test_a_block_that_takes_too_long(spark, tables, monkeypatch):
    sql = [f"SELECT COUNT(*) FROM x AS a WHERE a.v = {i}" for i in range(3)]
    real = labelling.cards.within
    monkeypatch.setattr(labelling.cards, "within", lambda s, work, timeout, label="": (labelling.TIMEOUT, None) if label == "labels part=0" else real(s, work, timeout, label))
    assert labelled(spark, tables, sql, batch=2) == brute(tables, sql)
