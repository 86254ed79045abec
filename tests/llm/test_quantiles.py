import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinlens.functions.ordered import decode_array, encode, encode_array
from joinlens.llm import quantiles as Q


def rank_error(values, got, q):
    values = np.sort(values)
    tol = abs(got) * 2.0**-10
    rank = math.ceil(q * len(values))
    low, high = np.searchsorted(values, got - tol, "left") + 1, np.searchsorted(values, got + tol, "right")
    return max(0, low - rank, rank - high) / len(values)


SPECIAL = [0.0, -0.0, 1.0, -1.0, 1e308, -1e308, 5e-324, -5e-324, 2.2250738585072014e-308, float("inf"), float("-inf"), 2.0**52, 0.1, 1023.9999999999999, 1024.0]


def test_codes_agree_and_keep_order(spark):
    rng = random.Random(1)
    values = SPECIAL + [rng.choice([-1, 1]) * math.exp(rng.uniform(-300, 300)) for _ in range(2000)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(encode("v")).collect()]
    want = encode_array(np.array(values))
    zero = [i for i, v in enumerate(values) if v == 0]
    assert [g for i, g in enumerate(got) if i not in zero] == [w for i, w in enumerate(want) if i not in zero]
    order = np.argsort(values, kind="stable")
    assert (np.diff(np.array(got)[order]) >= 0).all()
    finite = np.array([v for v in values if np.isfinite(v) and abs(v) > 1e-300])
    assert (np.abs(decode_array(encode_array(finite)) - finite) <= np.abs(finite) * 2.0**-11 * 1.01).all()


@pytest.mark.parametrize("kind", ["lognormal", "ties", "two", "uniform"])
def test_sketch_rank_error(kind):
    rng = np.random.default_rng(7)
    n = 60_000
    values = {"lognormal": np.exp(rng.normal(0, 3, n)), "ties": np.where(rng.random(n) < 0.5, 1.0, np.exp(rng.normal(2, 2, n))),
              "two": np.concatenate((rng.normal(-50, 1, n // 2), rng.normal(1e6, 1e5, n // 2))), "uniform": rng.uniform(0, 1, n)}[kind]
    whole = Q.Sketch(Q.width_for(0.01))
    for part in np.array_split(values, 7):
        whole.merge(Q.Sketch(whole.width).add(*np.unique(encode_array(part), return_counts=True)))
    assert whole.total() == n
    for q in (0.5, 0.75, 0.9, 0.99):
        got = decode_array(whole.invert(np.array([math.ceil(q * n)])))[0]
        assert rank_error(values, got, q) < 0.01


def test_merge_is_linear_and_deletes():
    rng = np.random.default_rng(3)
    w = Q.width_for(0.05)
    a, b = (np.unique(encode_array(np.exp(rng.normal(m, 2, 20_000))), return_counts=True) for m in (0, 1))
    one, two = Q.Sketch(w).add(*a), Q.Sketch(w).add(*b)
    both = Q.Sketch(w).add(*a).merge(two)
    assert (both.counters == one.counters + two.counters).all()
    assert (both.add(b[0], -b[1]).counters == one.counters).all()
    assert not Q.Sketch(w).add(*a).add(a[0], -a[1]).counters.any()
    with pytest.raises(ValueError):
        one.merge(Q.Sketch(2 * w))
    with pytest.raises(ValueError):
        Q.width_for(0)


def test_packing_round_trip():
    rng = np.random.default_rng(6)
    for w in (16, 512):
        for n in (0, 1, 7, 300, 40_000):
            for scale in (1, 10**4, 10**9, 10**12):
                sketch = Q.Sketch(w).add(rng.integers(0, 2**22, n), rng.integers(-scale, scale, n))
                width, at, values = Q.unpack(sketch.pack())
                again = Q.Sketch(width)
                again.counters[at] += values
                assert width == w and (again.counters == sketch.counters).all()


def test_small_groups_are_near_exact():
    rng = np.random.default_rng(8)
    off = []
    for n in (1, 2, 5, 9, 30):
        for _ in range(40):
            values = np.exp(rng.normal(3, 2, n))
            sketch = Q.Sketch(Q.width_for(0.01)).add(encode_array(values), np.ones(n, np.int64))
            got = decode_array(sketch.invert(np.array([math.ceil(0.5 * n)])))[0]
            off.append(rank_error(values, got, 0.5) * n)
    assert max(off) <= 1 and sum(o > 0 for o in off) <= 4


def dirty(seed, n=6000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = rng.choice(["hot", "hot", "a", None])
        rows.append((i, group, f"2024-01-{rng.randint(1, 9):02}", rng.choice([1.0, rng.uniform(0, 1e4), -rng.uniform(0, 5), None, float("nan"), float("inf")]), "clash"))
    return rows + rows[:500]  # delivered again


SCHEMA = "id long, g string, day string, v double, code string"


def test_groups_days_and_dirty_values(spark):
    rows = dirty(5)
    df = spark.createDataFrame(rows, SCHEMA)
    direct = {r.g: r for r in Q.merge_sketches(Q.sketch_groups(df, "id", ["g"], "v"), ["g"], [0.5, 0.9]).collect()}
    days = Q.sketch_groups(df, "id", ["g", "day"], "v")
    in_two_steps = Q.merge_sketches(Q.merge_sketches(days, ["g", "day"]), ["g"], [0.5, 0.9]).collect()
    assert {r.g: (r.n, r.vals) for r in in_two_steps} == {g: (r.n, r.vals) for g, r in direct.items()}
    for g in ("hot", "a", None):
        exact = np.array([v for _, v in {(r[0], r[3]) for r in rows if r[1] == g and r[3] is not None and r[3] == r[3]}])
        assert direct[g].n == len(exact)
        for q, got in zip((0.5, 0.9), direct[g].vals):
            assert got == float("inf") or rank_error(exact, got, q) < 0.01
    assert Q.merge_sketches(days.limit(0), ["g"], [0.5]).count() == 0


def test_hot_groups_come_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(dirty(6), SCHEMA)
    want = {tuple(r)[:2]: r.vals for r in Q.merge_sketches(Q.sketch_groups(df, "id", ["g"], "v"), ["g"], [0.5]).collect()}
    for most in (Q.BROADCAST_GROUPS, 0):  # looked up by a broadcast, or by a join
        monkeypatch.setattr(Q, "BROADCAST_GROUPS", most)
        parts = Q.sketch_groups(df, "id", ["g"], "v", group_rows=100)
        assert parts.where("g = 'hot'").count() > 10
        for fan in (0, 3):
            assert {tuple(r)[:2]: r.vals for r in Q.merge_sketches(parts, ["g"], [0.5], fan).collect()} == want


def test_rows_are_deleted(spark):
    rows = dirty(7)
    keep, gone = (spark.createDataFrame([r for r in rows if (r[0] % 3 > 0) == k], SCHEMA) for k in (True, False))
    whole = Q.sketch_groups(spark.createDataFrame(rows, SCHEMA), "id", ["g"], "v")
    less = whole.unionByName(Q.sketch_groups(gone, "id", ["g"], "v", sign=-1))
    left = {tuple(r)[:2]: r.vals for r in Q.merge_sketches(less, ["g"], [0.5, 0.99]).collect()}
    assert left == {tuple(r)[:2]: r.vals for r in Q.merge_sketches(Q.sketch_groups(keep, "id", ["g"], "v"), ["g"], [0.5, 0.99]).collect()}


def test_a_thousand_dense_days(spark):
    rng = np.random.default_rng(9)
    w = Q.width_for(0.01)
    packed, values = [], []
    for _ in range(40):
        v = np.exp(rng.normal(2, 2, 5000))
        packed.append(Q.Sketch(w).add(encode_array(v), np.ones(5000, np.int64)).pack())
        values.append(v)
    days = spark.createDataFrame([("hot", i % 40) for i in range(1000)], "g string, i int").join(
        spark.createDataFrame(list(enumerate(packed)), "i int, sketch binary"), "i").select("g", F.lit(0).alias("part"), "sketch")
    found = Q.merge_sketches(days, ["g"], [0.5, 0.9, 0.99]).first()
    assert found.n == 1000 * 5000
    for q, got in zip((0.5, 0.9, 0.99), found.vals):
        assert rank_error(np.concatenate(values), got, q) < 0.01


def test_null_ids_and_invalid_values(spark):
    schema = "id long, g string, v double"
    invalid = spark.createDataFrame([(1, "a", None), (2, "a", float("nan"))], schema)
    assert Q.sketch_groups(invalid, "id", ["g"], "v").count() == 0
    rows = spark.createDataFrame([(None, "a", 1.0), (None, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0), (1, "a", 2.0)], schema)
    assert Q.sketch_groups(rows, "id", ["g"], "v").first().n == 4
