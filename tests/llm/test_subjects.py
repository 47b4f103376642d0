"""Subjects: held-out accuracy on the labelled documents, labels from metadata, and odd texts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import subjects


@pytest.mark.parametrize(("folder", "least"), [("sf0.1", 0.9), ("check_l", 0.95)])
def test_held_out_accuracy(spark, folder, least):
    """Against labels of which a few are wrong by intent: 0.96 and 0.92 with 830 labelled documents, 0.98 and 0.98 with 4,000."""
    if not os.path.exists(f"/root/testdata/{folder}"):
        pytest.skip("no such data here")
    docs, labels, areas = (spark.read.parquet(f"/root/testdata/{folder}/{n}.parquet") for n in ("documents", "subject_labels", "subjects"))
    out = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(8)) == 0
    model = subjects.fitted(docs, labels.where(~out), areas)
    truth = subjects.hand_labels(labels.where(out), areas)
    want = {(r.doc_id, r.s) for r in truth.select("doc_id", F.explode("names").alias("s")).collect()}
    got = {(r.doc_id, r.subject) for r in subjects.assigned(docs.join(truth, "doc_id", "left_semi"), model).collect()}
    both = len(got & want)
    print(folder, both / len(got), both / len(want))
    assert both / len(got) >= least and both / len(want) >= least, (both / len(got), both / len(want))


def test_sentences():
    said = subjects.sentences("<p>The cipher is <b>weak</b>.</p>\n```\nlog line of many words here\n```\nNo. " + "f" * 500 + "\n> Das Tor fiel früh!")
    assert said == [["the", "cipher", "is", "weak"], ["das", "tor", "fiel", "früh"]]
    assert subjects.sentences(None) == subjects.sentences("") == subjects.sentences("404") == []


def test_features():
    texts = [None, "", "404. x", "The keys are here. Two words.\nA key is there! And don't stop at 3.5 or so", "?? 12", "Das Tor fiel früh"]
    words, sizes, owner = subjects.hashed(texts)
    listed = [(i, s) for i, t in enumerate(texts) for s in subjects.sentences(t)]
    assert [len(s) for _, s in listed] == sizes.tolist() == [4, 4, 6, 4] and owner.tolist() == [i for i, _ in listed] == [3, 3, 3, 5]
    assert words.tolist() == [subjects._hash(w) for _, s in listed for w in s]
    f = subjects.Features.of(words, sizes)
    assert f.size.tolist() == [7, 7, 11, 7] and f.start.tolist() == [0, 7, 14, 25] and len(f.at) == 32
    assert len(set(f.at[:7])) == 7 and f.at[1] == f.at[8]  # keys and key
    alone = subjects.Features.of(words[8:14], sizes[2:3])
    assert np.array_equal(alone.at, f.at[14:25])
    assert len(subjects.Features.of(*subjects.hashed([None])[:2]).at) == 0


SPORT = ("The striker scored a goal. The coach praised the striker.", {"sport"})
LAW = ("The court read the contract. The judge signed the contract.", {"law"})


def small_model(spark):
    return subjects.train(spark, [SPORT] * 3 + [LAW] * 3 + [("Nothing happened here today.", {"none"})], ["sport", "law"], {"sport": "Goals and strikers.", "law": "Courts and contracts."})


def test_odd_texts(spark):
    model = small_model(spark)
    rows = [(1, "The striker met the coach again.", "x"), (2, None, "x"), (3, "", "x"), (4, "?? 12", "x"), (5, "The judge read the contract. " * 100_000, "x"), (None, "The striker scored a goal.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.assigned(df, model).collect()}
    assert got == {(1, "sport"), (5, "law")}
    assert subjects.assigned(df.limit(0), model).count() == 0


AREAS = "subject string, title string, description string"


def test_hand_labels(spark):
    labels = spark.createDataFrame([(1, " Sport ", "x"), (1, "law", "y"), (3, "law", "y"), (4, "none", "z"), (None, "law", "z")], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("sport", "S", "d"), ("Law", None, None), (None, "x", "y")], AREAS)
    assert {(r.doc_id, tuple(r.names)) for r in subjects.hand_labels(labels, areas).collect()} == {(1, ("Law", "sport")), (3, ("Law",)), (4, ())}


def test_labels_from_metadata(spark):
    # the address names the subject for half of the documents; few of these are labelled by hand
    rows = []
    for i in range(400):
        text, subject = (SPORT[0], "sport") if i % 2 else (LAW[0], "law")
        rows.append((i, text, f"https://h/{subject}-office/app" if i % 4 < 2 else "https://h/misc/app", "Wiki", "page", "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, repository_url string, source string, doc_kind string, subject string")
    labels = spark.createDataFrame([(i, "sport" if i % 2 else "law", "a") for i in range(80)], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("sport", "S", "d"), ("law", "L", "d")], AREAS)
    told = subjects.hand_labels(labels, areas)
    found = subjects.evidence(docs, told)
    assert {(r.token, r.subject) for r in found.collect()} == {("address:sport", "sport"), ("address:law", "law")}
    weak = {r.doc_id: r.names for r in subjects.metadata_labels(docs, found, told).collect()}
    assert weak == {i: ["sport" if i % 2 else "law"] for i in range(80, 400) if i % 4 < 2}
    headed = spark.createDataFrame([(1, "# Court news\nText\n## More", "x")], "doc_id long, text string, extra string")
    assert {r.token for r in subjects._metadata(headed).collect()} == {"heading:court", "heading:news", "heading:more"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "The striker met the coach again."), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("sport", "Sport", "Striker, coach and goal.")], AREAS)
    model = subjects.fitted(docs, labels, areas)
    assert model.subjects == ["sport"] and model.level.tolist() == [0.5]
    assert subjects.assigned(docs, subjects.fitted(docs, labels, areas.limit(0))).count() == 0
    assert subjects.fitted(docs.limit(0), labels, areas).subjects == ["sport"]


def test_unclosed_fence_is_a_line():
    closed = "Before the log stands this.\n```\nsome log line here\n```\nBehind the log stands this."
    assert len(subjects.sentences(closed)) == 2
    assert len(subjects.sentences("```\nThe whole text follows. It is judged to its end.")) == 2
    assert len(subjects.sentences(closed + "\n```\nAnd this is left.")) == 3
