import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinlens.llm import packing as P


def unfold(segments):
    """(size, item) -> container."""
    out = {}
    for size, low, high, first, each in segments:
        for i in range(low, high):
            assert (size, i) not in out
            out[size, i] = first + (i - low) // each
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200), st.integers(1, 3))
def test_plan_is_valid(sizes, scale):
    capacity = 60
    counts = np.bincount(sizes, minlength=capacity + 1) * scale
    segments, n = P.plan(counts, capacity)
    placed, used = unfold(segments), defaultdict(int)
    assert sum(counts[1:]) == len(placed)
    for (size, i), container in placed.items():
        assert 0 <= container < n and i < counts[size]
        used[container] += size
    assert len(used) == n and max(used.values(), default=0) <= capacity


def test_large_items_pair_greedily():
    counts = np.zeros(101, int)
    counts[[60, 40, 50, 90, 10]] = [1, 1, 2, 1, 1]
    assert P.plan(counts, 100)[1] == 3  # 60 + 40, 50 + 50, 90 + 10


def test_near_the_lower_bound_and_bounded_work():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(2048, rng.lognormal(5.5, 1.2, 2_000_000).astype(int) + 1), minlength=2049)
    segments, n = P.plan(counts, 2048)
    assert n <= np.ceil((counts * np.arange(2049)).sum() / 2048) * 1.002
    assert len(segments) < 50_000


@pytest.mark.parametrize("most", [P.BUCKET_ITEMS, 50])
def test_pack(spark, monkeypatch, most):
    monkeypatch.setattr(P, "BUCKET_ITEMS", most)
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 0, 5, 40, 41, 700, 1000, 1001, 2500, 999, rng.randint(1, 400)]), "c") for i in range(3000)] + [(None, 7, "c"), (None, 7, "c"), (5, 30, "c")]
    df = spark.createDataFrame(sizes, "doc_id long, n long, container string")
    made = P.pack(P.token_items(df, "doc_id", "n", 1000), "doc_id", 1000).collect()
    used, total = defaultdict(int), defaultdict(int)
    for r in made:
        used[r.container] += r.n_tokens
        total[r.doc_id] += r.n_tokens
        assert r.n_tokens <= 1000 and (r.part == 0 or r.token_from == r.part * 1000)
    want = defaultdict(int)
    for i, n, _ in sizes:
        want[i] += n
    assert total == want and max(used.values()) <= 1000
    assert len(made) == sum(max(1, -(-n // 1000)) for _, n, _ in sizes)
    assert all(r.part == 0 for r in made if r.n_tokens < 1000 and r.doc_id in {i for i, n, _ in sizes if n <= 1000})


@pytest.mark.parametrize("rows", [[], [(1, 0)], [(1, 0), (2, 0)]])
def test_nothing_to_pack(spark, rows):
    made = P.pack(P.token_items(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", 10), "doc_id", 10).collect()
    assert sorted(r.doc_id for r in made) == [i for i, _ in rows]
