"""Term counts against counting by hand."""

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import terms


def brute(rows, max_n):
    occurs, where = Counter(), defaultdict(set)
    for rid, field, tokens in rows:
        tokens = [t for t in tokens or [] if t]
        for n in range(1, max_n + 1):
            for i in range(len(tokens) - n + 1):
                key = (field, n, " ".join(tokens[i : i + n]))
                occurs[key] += 1
                where[key].add(rid)
    return {(*k, v, len(where[k])) for k, v in occurs.items()}


def run(spark, rows, max_n):
    df = spark.createDataFrame(rows, "id string, field string, tokens array<string>")
    return {tuple(r) for r in terms.ngrams(df, max_n).select("field", "size", "gram", "occurrences", "records").collect()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("fg"), st.lists(st.sampled_from(["a", "b", "ab", "é", "", None]), max_size=9)), max_size=12), st.integers(1, 4))
def test_random(spark, lists, max_n):
    rows = [(str(i), f, t) for i, (f, t) in enumerate(lists)]
    assert run(spark, rows, max_n) == brute(rows, max_n)


def test_cases(spark):
    rows = [("1", "f", None), ("2", "f", []), ("3", "f", ["x"] * 500), ("4", "f", ["x", None, "", "y" * 50_000]), ("5", "g", ["x"])]
    for n in (1, 3):
        assert run(spark, rows, n) == brute(rows, n)
    assert run(spark, [], 2) == set()


def test_many_batches(spark):
    rows = [(str(i), "f", [f"t{j:04d}" for j in range(i % 7, 3000, 7)]) for i in range(60)]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_marks(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("c", 5), ("d", 6)], "term string, records long")
    total = spark.createDataFrame([(100,)], "total long")
    assert {r.term: r.mark for r in terms.marked(counts, total).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}
