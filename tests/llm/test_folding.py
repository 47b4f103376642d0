"""Formatting copies against canonical texts."""

import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import folding


def canon(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "" if unicodedata.category(c)[0] in "LNM")


def brute(rows):
    groups = defaultdict(list)
    for rid, title, path, cve in rows:
        groups[canon(title), canon(path), tuple(sorted(filter(None, map(canon, cve or []))))].append(rid)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "id string, title string, path string, cve array<string>")
    return {(r.first_id, r.id) for r in folding.copies(df, ["title", "path"], ["cve"], **options).collect()}


TEXT = st.one_of(st.none(), st.text(alphabet="aAbB iIİ éÉ -—“.😀𝐀1", max_size=6))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT, st.one_of(st.none(), st.lists(TEXT, max_size=3))), max_size=25))
def test_random(spark, rows):
    rows = [(f"{i:03d}", *r) for i, r in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("modulus", [1, 3])
def test_colliding_hashes(spark, modulus):
    rows = [(f"{i:03d}", f"T{i % 4}", None if i % 3 else "p", [f"c{i % 2}", "d"]) for i in range(24)]
    assert run(spark, rows, modulus=modulus) == brute(rows)


def test_cases(spark):
    long = "Word " * 60_000
    rows = [
        ("a", None, None, None), ("b", "", "", []), ("c", " -–— ", ".", ["", None, " "]), ("d", long, "x", ["1", "2"]), ("e", long.upper() + "!", "X", ["2", "1"]),
        ("f", long + "y", "x", ["1", "2"]), ("g", "t", "p", ["1", "1"]), ("h", "t", "p", ["1"]), ("i", "tp", "", ["1"]),
    ]
    assert run(spark, rows) == brute(rows) == {("a", "b"), ("a", "c"), ("d", "e")}
    assert run(spark, []) == set()


def test_hot_group_and_clashing_columns(spark):
    rows = [(f"{i:05d}", "Same  title" if i % 3 else f"t{i}", "P", ["x"]) for i in range(3000)]
    assert run(spark, rows, hot_share=0.01, salts=4) == brute(rows)
    df = spark.createDataFrame([("1", "A", "x"), ("2", "a", "y")], "id string, title string, h1 string")
    assert folding.copies(df, ["title"], []).collect()[0].asDict() == {"first_id": "1", "id": "2"}
