import numpy as np

from joinlens.llm import mixture as M

TARGETS = "mix_id int, k string, target_permille int, sample_percent int, min_records int"


def run(spark, rows, targets, margins=("m",)):
    df = spark.createDataFrame(rows, "id long, k string, m int, weight double, mix_id int")
    return M.sample_to_targets(df, "id", "k", list(margins), spark.createDataFrame(targets, TARGETS))


def test_rake_meets_margins():
    counts = np.array([100, 20, 30, 40])
    a, b = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    weight, error = M.rake(counts, [(a, np.array([10.0, 10.0])), (b, np.array([5.0, 15.0]))])
    fitted = counts * weight
    assert error < 1e-9
    assert np.allclose(np.bincount(a, fitted), [10, 10]) and np.allclose(np.bincount(b, fitted), [5, 15], atol=1e-6)


def test_quotas():
    def of(target, total, at_hand, least):
        return M.quotas(np.array(target, float), total, np.array(at_hand), np.array(least)).tolist()

    assert of([500, 300, 200], 11, [100, 2, 100], [1, 1, 5]) == [4, 2, 5]  # lifted, cut, and the sum kept
    assert of([500, 300, 200], 100, [100, 5, 100], [0, 0, 0]) == [68, 5, 27]  # what is missing goes by target
    assert of([900, 100], 100, [20, 30], [0, 0]) == [20, 30]  # rows do not suffice
    assert of([500, 500], 10, [100, 100], [8, 8]) == [8, 8]  # minimums make the sample larger
    assert of([500, 500], 100, [1000, 49], [80, 0]) == [80, 49]  # a category that gives all it has keeps it
    assert of([0, 1000], 10, [5, 5], [0, 0]) == [0, 5]
    assert of([], 10, [], []) == [] and of([1000], 0, [5], [0]) == [0]


def test_quotas_hold_their_promises():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = rng.integers(1, 9)
        target, at_hand, least = rng.multinomial(1000, np.ones(k) / k), rng.integers(0, 400, k), rng.integers(0, 20, k)
        size = int(rng.integers(0, 900))
        q = M.quotas(target.astype(float), size, at_hand, least)
        assert (q <= at_hand).all() and (q >= np.minimum(least, at_hand)).all()
        could = at_hand[target > 0].sum() + np.minimum(least, at_hand)[target == 0].sum()
        assert q.sum() >= min(size, could)
        assert (q[at_hand * 1000 < target * size] == at_hand[at_hand * 1000 < target * size]).all()  # short ones give all
        if q.sum() > size:  # only minimums and categories that give all they have are left
            assert ((q <= least) | (q == at_hand)).all()


def test_shares_minimum_and_gaps(spark):
    rows = [(i, "hot", i % 4, 1.0, 1) for i in range(3000)] + [(3000 + i, "small", None, 1.0, 1) for i in range(30)] + [(4000 + i, None, 1, 1.0, 1) for i in range(500)]
    mixes = [(1, "hot", 700, 10, 1), (1, "small", 200, 10, 1), (1, "gone", 100, 10, 2), (2, "hot", 995, 10, 1), (2, "small", 5, 10, 20)]
    sample, report, _ = run(spark, rows, mixes)
    found = {(r.mix_id, r.k): r for r in report.collect()}
    assert found[1, "hot"].drawn == 273 and found[1, "small"].drawn == 30 and found[1, "gone"].drawn == 0  # 303 in all
    assert (found[1, "small"].unmet, found[1, "gone"].unmet, found[1, "hot"].unmet, found[2, "small"].unmet) == (True, True, False, False)
    assert found[2, "small"].drawn == 20 and found[2, "hot"].drawn == 283  # lifted to the minimum, the sum kept
    drawn = sample.collect()
    assert len({(r.mix_id, r.id) for r in drawn}) == len(drawn) == 606
    assert {tuple(r) for r in run(spark, rows, mixes)[0].collect()} == {tuple(r) for r in drawn}


def test_margins_are_raked_and_reported(spark):
    """The mix takes mostly b, whose rows have another margin; the weights within a and b make up for it."""
    rows = [(i, "a", 0 if i % 10 else 1, 1.0, 1) for i in range(8000)] + [(10_000 + i, "b", 1 if i % 10 else 0, 1.0, 1) for i in range(8000)]
    sample, report, margins = run(spark, rows, [(1, "a", 300, 20, 1), (1, "b", 700, 20, 1)])
    got = {r.value: r for r in margins.collect()}
    assert set(got) == {"0", "1"} and all(abs(r.target_share - 0.5) < 1e-9 for r in got.values())
    assert all(abs(r.gap) < 0.03 for r in got.values())  # 0.34 and 0.66 without raking
    assert all(r.fit_error < 1e-6 and abs(r.gap) < 0.001 for r in report.collect())
    assert run(spark, rows, [(1, "a", 1000, 20, 1)], ())[2].count() == 0
    _, report, margins = run(spark, [(1, "a", 0, 1.0, 1), (2, "b", 1, 1.0, 1)] * 50, [(1, "a", 900, 20, 0), (1, "b", 100, 20, 0)])
    assert all(r.fit_error > 0.1 and r.gap == 0 for r in report.collect())  # margins that contradict: said, not hidden
    assert sorted(r.gap for r in margins.collect()) == [-0.4, 0.4]


def test_exact_cut_and_repeated_rows(spark):
    rows = [(i % 50, "a", 0, 1.0, 1) for i in range(1000)]  # twenty rows an id: equal keys
    sample, report, _ = run(spark, rows, [(1, "a", 1000, 33, 1)])
    assert sample.count() == 330 == report.first().drawn


def test_empty(spark):
    sample, report, _ = run(spark, [], [(1, "a", 1000, 10, 3)])
    assert sample.count() == 0 and report.first().unmet
    sample, report, _ = run(spark, [(1, "a", 1, 1.0, 1)], [])
    assert sample.count() == report.count() == 0


def test_zero_target_with_minimum(spark):
    rows = [(i, "hot", i % 2, 1.0, 1) for i in range(400)] + [(1000 + i, "least", i % 2, 1.0, 1) for i in range(30)] + [(2000 + i, "none", 0, 1.0, 1) for i in range(30)]
    _, report, _ = run(spark, rows, [(1, "hot", 1000, 10, 0), (1, "least", 0, 10, 7), (1, "none", 0, 10, 0), (2, "hot", 1000, 0, 3)])
    found = {(r.mix_id, r.k): (r.quota, r.drawn, r.unmet) for r in report.collect()}
    assert found == {(1, "hot"): (39, 39, False), (1, "least"): (7, 7, False), (1, "none"): (0, 0, False), (2, "hot"): (3, 3, False)}
