import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from joinlens.llm import overlap as O


def words(text):
    return frozenset(re.findall("[a-z0-9_]+", text.lower())) if text else frozenset()


def brute(rows, t):
    t = Fraction(t)
    out = set()
    for i, a, s in rows:
        for j, b, r in rows:
            if s in ("val", "test") and r == "train" and words(a) and words(b):
                if len(words(a) & words(b)) >= t * len(words(a) | words(b)):
                    out.add((i, j))
    return out


def found(spark, rows, t, **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, text string, split string, set_id string, n int")
    held = F.coalesce(F.col("split").isin("val", "test"), F.lit(False))
    return O.cross_overlaps(df, "id", "text", held, F.coalesce(F.col("split") == "train", F.lit(False)), t, **more)


@pytest.mark.parametrize("t", ["0.85", "0.5", "1", "0.3"])
def test_equals_brute_force(spark, t):
    rng = random.Random(int(float(t) * 100))
    base = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 30))] for _ in range(30)]
    rows = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 60)}"
        if rng.random() < 0.3:
            w = w[: max(1, len(w) // 2)]
        rng.shuffle(w)
        text = rng.choice([" ", ", ", "\n"]).join(w)
        rows.append((i, rng.choice([text, text.upper()]), rng.choice(["train", "train", "val", "test", None])))
    rows += [(900, None, "val"), (901, "", "train"), (902, "?!", "test"), (903, "?!", "train")]
    links, members = found(spark, rows, t, frequent_words=20, pair_words=12)  # single words beyond, both near the limit
    assert {tuple(r) for r in found(spark, rows, t)[0].select("eval_set", "train_set").collect()} == {tuple(r)[:2] for r in links.collect()}
    pairs = [tuple(r) for r in O.overlap_pairs(links, members, "id").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, t)
    per_row = {r.id: r.n_train_rows for r in O.overlap_rows(links, members, "id").collect()}
    assert per_row == {i: sum(a == i for a, _ in pairs) for i in {a for a, _ in pairs}}


def test_hot_copies_and_long_text(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(i, "select a from b where c = 1", "train") for i in range(400)] + [(1000, "SELECT A FROM B WHERE C=1", "val"), (1001, long, "test"), (1002, long + " more", "train")]
    links, members = found(spark, rows, "0.85")
    assert links.count() == 2  # one link a class, whatever its copies
    assert {r.id: r.n_train_rows for r in O.overlap_rows(links, members, "id").collect()} == {1000: 400, 1001: 1}


def test_empty_sides(spark):
    assert found(spark, [], "0.85")[0].count() == 0
    assert found(spark, [(1, "a b", "train")], "0.85")[0].count() == 0


def test_entries_stay_linear():
    import numpy as np

    for n in (10, 100, 129, 150, 151, 1000, 20_000):
        entries = len(O._prefix_keys(np.array([n]), np.arange(n), np.zeros(n, np.int64), Fraction("0.85"), O.PAIR_WORDS)[0])
        assert entries <= 3 * n
