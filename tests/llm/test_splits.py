import random

import numpy as np

from joinlens.llm import splits
from joinlens.llm.canonical import with_query_hash
from joinlens.llm.components import connected_components


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent if any((x == a) != (x == b) for a, b in edges)}


def test_components(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("s", f"s{i}") for i in range(50)]
    noise = [(f"n{rng.randint(0, 80)}", f"n{rng.randint(0, 80)}") for _ in range(40)]
    edges = chain + star + noise + [(None, "x"), ("y", "y"), chain[0]]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert found == brute_components(edges)
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_template_key(spark):
    df = spark.createDataFrame([(" 1-A.",), ("1a",), ("#",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(splits.template_key("t")).collect()] == ["1a", "1a", None, None, None]


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "qid long, template_key string, n_tables int, sql string, component string")
    return with_query_hash(df, "sql", ["qid", "template_key", "n_tables"])


def test_related_rows_stay_together(spark):
    rng = random.Random(3)
    rows = []
    for i in range(800):
        key = rng.choice([None, "hot", "hot", *(f"k{j}" for j in range(120))])
        sql = rng.choice([None, "", f"select {rng.randint(0, 300)} from t", f"select {i} from u"])
        rows.append((i, key, rng.choice([None, 1, 2, 3]), sql, "clash"))
    shares = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
    found = splits.grouped_split(rows_of(spark, rows), "qid", "template_key", "n_tables", shares).collect()
    assert sorted(r.qid for r in found) == list(range(800))
    split = {r.qid: r.split for r in found}
    for pick in (1, 3):
        seen = {}
        for r in rows:
            if r[pick]:
                assert seen.setdefault(r[pick], split[r[0]]) == split[r[0]]
    edges = [(("k", r[1]) if r[1] else ("q", r[0]), ("s", r[3]) if r[3] else ("q", r[0])) for r in rows]
    parts = len(set(brute_components([*edges, *((("x", 0), ("x", 0)),)]).values())) + sum(a == b for a, b in edges)
    assert len({r.component for r in found}) == parts


def test_small_and_empty(spark):
    assert splits.grouped_split(rows_of(spark, []), "qid", "template_key", "n_tables", [("train", 1.0)]).count() == 0
    one = splits.grouped_split(rows_of(spark, [(1, None, None, None, None)]), "qid", "template_key", "n_tables", [("train", 0.8), ("test", 0.2)]).collect()
    assert [r.split for r in one] == ["train"]


def place(vectors, times, shares):
    """Rows by split and label after placing all units."""
    times = np.asarray(times)
    st = splits.Stratifier((vectors * times[:, None]).sum(0), np.array(shares))
    units = [(np.flatnonzero(v), v[v > 0], int(t)) for v, t in zip(vectors, times)]
    placed = st.place(units)
    assert [sum(n for _, n in p) for p in placed] == [t if v.any() else 0 for v, t in zip(vectors, times)]
    out = np.zeros((len(shares), vectors.shape[1]))
    for v, parts in zip(vectors, placed):
        for split, n in parts:
            out[split] += v * n
    return out


def test_shares_and_labels():
    rng = np.random.default_rng(4)
    few = (rng.random((4000, 8)) < 0.05) * rng.integers(1, 40, (4000, 8))  # units with few labels, as components have
    for vectors, bound in ((few, 0.01), (rng.integers(0, 5, (4000, 6)), 0.05)):
        found = place(vectors, np.ones(len(vectors), int), (0.8, 0.1, 0.1))
        for s, share in enumerate((0.8, 0.1, 0.1)):
            assert np.abs(found[s] / vectors.sum(0) - share).max() < bound
            assert abs(found[s].sum() / vectors.sum() - share) < 0.005


def test_equal_vectors_are_as_good_as_single_units():
    vectors, times = np.array([[1, 0], [0, 1], [3, 1], [50, 7]]), np.array([20_000, 3_000, 400, 6])
    whole = (vectors * times[:, None]).sum(0)
    for v, t in ((vectors, times), (np.repeat(vectors, times, 0), np.ones(times.sum(), int))):
        found = place(v, t, (0.8, 0.1, 0.1))
        assert np.abs(found / whole - np.array([[0.8], [0.1], [0.1]])).max() < 0.001
    many = place(vectors, times * 10**9, (0.8, 0.1, 0.1))  # no loop over components
    assert np.abs(many / (whole * 10**9) - np.array([[0.8], [0.1], [0.1]])).max() < 0.005


def test_every_component_is_placed_by_its_labels(spark, monkeypatch):
    """A rare label in single-row components: hashing these into blocks would scatter it, placing them does not."""
    rng = random.Random(9)
    rows = [(i, f"k{i}", i % 3 if i % 50 else 1000 + i % 400, f"select {i} from t", "") for i in range(4000)]
    rows += [(4000 + i, "hot", rng.randint(0, 2), f"choose {i} from u", "") for i in range(2000)]  # a third of the rows
    for stretch in (splits.VECTORS, 5):
        monkeypatch.setattr(splits, "VECTORS", stretch)
        found = {r.qid: r for r in splits.grouped_split(rows_of(spark, rows), "qid", "template_key", "n_tables", [("train", 0.8), ("val", 0.1), ("test", 0.1)]).collect()}
        assert len(found) == 6000 and len({found[r[0]].split for r in rows if r[1] == "hot"}) == 1
        for split, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
            assert abs(sum(r.split == split for r in found.values()) / 6000 - share) < 0.002
            rare = [found[r[0]].split == split for r in rows if r[2] >= 1000]
            assert stretch == 5 or abs(sum(rare) / len(rare) - share) < 0.03
    monkeypatch.setattr(splits, "MAX_LABELS", 4)
    try:
        splits.grouped_split(rows_of(spark, rows), "qid", "template_key", "n_tables", [("train", 1.0)])
        raise AssertionError
    except ValueError:
        pass


def test_linked_keys(spark):
    rows = [(1, "a", 1, "select 1 from t", ""), (2, "b", 1, "SELECT 1 FROM t;", ""), (3, "b", 1, "select 2 from t", ""), (4, "c", 1, "select 2 from t", ""), (5, "d", 1, "select 3 from t", ""), (6, None, 1, "select 3 from t", "")]
    found = {tuple(r) for r in splits.linked_keys(rows_of(spark, rows), "template_key").collect()}
    assert found == {("a", "a"), ("b", "a"), ("c", "a")}
