import random

import pytest
from gleanix.llm import mixing as M
from gleanix.session import cut
from hypothesis import given, settings
from hypothesis import strategies as st


def _best(budget, available):
    sums = {0}
    for n, c in available.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= budget}
    return max(sums)


@settings(deadline=None, max_examples=200)
@given(st.integers(0, 120), st.dictionaries(st.integers(1, 40), st.integers(0, 4), max_size=6))
def test_exact_sum_is_optimal(budget, available):
    taken = M.exact_sum(budget, available)
    assert all(0 < k <= available[n] for n, k in taken.items())
    assert sum(n * k for n, k in taken.items()) == _best(budget, available)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 200_000), st.dictionaries(st.integers(1, 3000), st.integers(1, 60), min_size=1, max_size=30))
def test_fit_stays_within_budget_and_supply(budget, histogram):
    lengths, counts = list(histogram), list(histogram.values())
    taken = M.fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    total = sum(n * t for n, t in zip(lengths, taken))
    supply = sum(n * c for n, c in zip(lengths, counts))
    assert total <= budget and (budget < supply or total == supply)


def test_fit_reaches_large_budgets_exactly():
    rng = random.Random(1)
    lengths = sorted(rng.sample(range(20, 4000), 400))
    counts = [rng.randrange(1, 50) for _ in lengths]
    for budget in (10_000, 1_234_567, 5_000_001):
        assert sum(n * t for n, t in zip(lengths, M.fit(lengths, counts, budget))) == budget


TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("gone", 0.1, 3), (None, 0.2, 1), ("never", 0.1, 0)]


def _tables(spark):
    rng = random.Random(8)
    rows = [(i, "a", rng.randrange(5, 400)) for i in range(2000)] + [(i, "b", rng.randrange(5, 200)) for i in range(2000, 2600)] + [(i, "c", 10) for i in range(2600, 2700)] + [(2700, "never", 5), (2701, "", 9), (2702, "a", 0), (None, "a", 3)]
    return rows, cut(spark.createDataFrame(rows, "doc_id BIGINT, src STRING, tokens INT"), "sized"), spark.createDataFrame(TARGETS, "source STRING, target_share DOUBLE, max_repeats INT")


def test_feasible_total_meets_all_shares_exactly(spark):
    rows, sized, targets = _tables(spark)
    got = M.mix(sized, targets, None).collect()
    assert len({r.doc_id for r in got}) == len(got)
    most = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.uses <= most[r.src] for r in got)
    has = {s: sum(n for _, x, n in rows if x == s and _ is not None) for s in "abc"}
    total = M.feasible_total([(0.5, 1, has["a"]), (0.3, 2, has["b"]), (0.1, 4, has["c"])])
    used = {s: sum(r.tokens * r.uses for r in got if r.src == s) for s in "abc"}
    for s, share in (("a", 0.5), ("b", 0.3)):
        assert used[s] == int(share * total)
    assert int(0.1 * total) - 10 < used["c"] <= int(0.1 * total)  # all its documents have ten tokens


def test_unreachable_total(spark):
    rows, sized, targets = _tables(spark)
    got = cut(M.mix(sized, targets, 10_000_000), "mix")
    assert all(r.uses == {"a": 1, "b": 2, "c": 4}[r.src] for r in got.collect())
    report = {r.source: r for r in M.report(got, sized, targets, "x").collect()}
    assert report["gone"].used_tokens == 0 and report["gone"].documents == 0 and report["never"].used_tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5


def test_hot_length_and_seeds(spark):
    sized = cut(spark.createDataFrame([(i, "a", 7) for i in range(9000)], "doc_id BIGINT, src STRING, tokens INT"), "sized")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    a, b, c = ({r.doc_id for r in M.mix(sized.repartition(n), targets, 7 * 1234, seed).collect()} for n, seed in ((1, 1), (6, 1), (1, 2)))
    assert len(a) == 1234 and a == b and a != c


def test_queries(spark, tables):
    docs = [(i, "some words " * (1 + i % 9), None, "A-b" if i % 3 else "a_B ", 0, None, None) for i in range(90)] + [(100, None, None, "a_b", None, None, None), (101, "text", None, None, None, None, None)]
    data = tables(extra="src,tokens,part,turn,uses,rank", documents=docs, mix_targets=[("a_b", 0.6, 1), ("none", 0.4, 2)])
    assert {r.doc_id for r in M.mixture(spark, data).collect()} <= set(range(90))
    rows = {(r.total, r.source): r for r in M.shares(spark, data).collect()}
    assert rows["feasible", "a_b"].actual_share == 1.0 and rows["collection", "none"].used_tokens == 0
    empty = tables()
    assert M.mixture(spark, empty).collect() == M.shares(spark, empty).collect() == []
    only = tables(mix_targets=[("x", 1.0, 1)])
    assert M.mixture(spark, only).collect() == [] and M.shares(spark, only).first().actual_share is None


@pytest.mark.parametrize("share, repeats, tokens", [(0.0, 1, 5), (0.5, 0, 5), (0.5, 1, 0)])
def test_nothing_is_feasible(share, repeats, tokens):
    assert M.feasible_total([(share, repeats, tokens)]) == 0
