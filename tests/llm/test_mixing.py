"""Mixing: exact subset sums, shares and caps."""

from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import mixing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 60))
def test_subset_sum(counts, budget):
    taken = mixing.subset_sum(counts, budget)
    assert all(k <= counts[n] for n, k in taken.items())
    reach = [sum(n * k for n, k in zip(counts, ks)) for ks in product(*(range(c + 1) for c in counts.values()))]
    assert sum(n * k for n, k in taken.items()) == max(r for r in reach if r <= budget)


def test_fit_large_budgets():
    counts = {n: 50 for n in range(7, 400, 3)}
    for budget in (0, 100, 40_000, 123_456, 10**9):
        taken = mixing.fit(counts, budget)
        assert all(0 < k <= counts[n] for n, k in taken.items())
        size = sum(n * k for n, k in taken.items())
        assert min(budget, sum(n * k for n, k in counts.items())) - size in range(7)


DOCS = "doc_id long, source string, tokens long, repeats string"


def test_mix(spark):
    docs = [(i, ("A ", "a", "b_x", "c", None)[i % 5] if i > 9 else "B-X", (i * 37) % 211 + 1, "z") for i in range(900)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b-x", 0.3, 3), ("gone", 0.2, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(spark.createDataFrame(docs, DOCS), targets)
    rows, said = mix.collect(), {r.source: r for r in report.collect()}
    assert set(said) == {"a", "b-x", "gone"} and said["gone"].tokens == 0
    assert all(1 <= r.repeats <= said[r.source].max_repeats for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    for s in ("a", "b-x"):
        assert sum(r.tokens * r.repeats for r in rows if r.source == s) == said[s].tokens
    assert abs(said["a"].actual_share - 0.625) < 1e-3 and abs(said["b-x"].actual_share - 0.375) < 1e-3
    again = mixing.mixed(spark.createDataFrame(docs, DOCS), targets)[0].collect()
    assert sorted(again) == sorted(rows)


def test_total_and_ties(spark):
    docs = [(i, "a", 5, "") for i in range(1000)]
    targets = spark.createDataFrame([("a", 1.0, 4)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(spark.createDataFrame(docs, DOCS), targets, total=7_503)
    assert report.first().tokens == 7_500
    assert {r.repeats for r in mix.collect()} == {1, 2}


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 4)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(spark.createDataFrame([], DOCS), targets)
    assert mix.count() == 0 and report.first().tokens == 0
    assert mixing.mixed(spark.createDataFrame([(1, "a", 5, "")], DOCS), targets.limit(0))[0].count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 900), st.integers(1, 30), min_size=1, max_size=40), st.floats(0, 1.1))
def test_fit_keeps_budget_and_counts(counts, part):
    available = sum(n * k for n, k in counts.items())
    budget = int(part * available)
    taken = mixing.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in taken.items())
    assert 0 <= min(budget, available) - sum(n * k for n, k in taken.items()) < max(counts)


def test_lengths_of_the_source_at_any_budget():
    # lengths that occur once or a few times; the mean length drawn is that of the source
    for counts in ({100 + i: 1 for i in range(4900)}, {100 + i: 20 for i in range(4900)}, {10 + i: 9 for i in range(300)}):
        mean = sum(n * k for n, k in counts.items()) / sum(counts.values())
        for part in (50, 20, 4, 2):
            budget = sum(n * k for n, k in counts.items()) // part
            taken = mixing.fit(counts, budget)
            assert sum(n * k for n, k in taken.items()) == budget
            drawn = sum(taken.values())
            assert abs(budget / drawn - mean) < 0.08 * mean
            low = sum(k for n, k in taken.items() if n < mean) / drawn
            assert 0.42 < low < 0.58


def test_one_hot_length_in_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 50)
    docs = [(i, "a", 7, "") for i in range(999)]
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(spark.createDataFrame(docs, DOCS), targets, total=7 * 1500)
    rows = mix.collect()
    assert sorted(r.repeats for r in rows) == [1] * 498 + [2] * 501 and report.first().tokens == 10_500
