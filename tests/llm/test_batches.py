"""Repeats across batches against comparing everything in order."""

import random
import time
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import batches

SCANS = "scan_id string, feed string, started_at timestamp, target struct<repository_url:string>, at int"
ROWS = "rec_id long, scan_id string, fingerprint string, title string, description string, text string, repo int"
T0 = datetime(2040, 1, 1)


def scan(i, repo="o/r", hours=None):
    return (f"b{i:03d}", "batch", T0 + timedelta(hours=i if hours is None else hours), (f"https://h/{repo}",), 1)


def row(rid, batch, title, body, fp=None):
    return (rid, f"b{batch:03d}", fp, title, body, "x", 1)


def run(spark, scans, rows, deliveries=1):
    got = batches.repeats(spark.createDataFrame(scans, SCANS), spark.createDataFrame(rows, ROWS), deliveries).collect()
    return sorted((r.id_a, r.id_b) for r in got)


TITLE = "Cache poisoning exposed by zuge image builder"
BODY = "An attacker with a legacy scheduler sees how one cursor trusts sealed namespace values. The eager registry duplicates a forked plugin under load while the branch trusts transient data. See ticket."


def test_formatting_order_and_few_words(spark):
    swapped = "The eager registry duplicates a forked plugin under load while the branch trusts transient data. An attacker with a legacy scheduler sees how one cursor trusts sealed namespace values! SEE TICKET"
    reworded = BODY.replace("legacy", "stale").replace("forked ", "") + " Reported again."
    merged = BODY.replace("values. The", "values of The")
    rows = [row(1, 1, TITLE, BODY), row(2, 2, TITLE.upper() + " (again)", swapped), row(3, 3, "Cache_poisoning.exposed by zuge image-builder", reworded), row(4, 4, TITLE, merged)]
    assert run(spark, [scan(i) for i in range(1, 5)], rows) == [(1, 2), (1, 3), (1, 4)]


def test_what_is_no_repeat(spark):
    other = BODY.split(". ")[0] + ". When a router arrives silently, this partial credential forwards every stale column and the runtime. The upstream branch drops a privileged report twice while the descriptor leaks privileged data."
    rows = [row(1, 1, TITLE, BODY), row(2, 2, "Weak token entropy inside mohu mail relay", BODY), row(3, 3, TITLE, other), row(4, 1, TITLE, BODY), row(5, 9, TITLE, BODY)]
    assert run(spark, [*(scan(i) for i in range(1, 4)), scan(9, "o/other")], rows) == []


def test_same_fingerprint_and_acceptance(spark):
    # 2 repeats 1 by fingerprint; 3 repeats only 2, which was not accepted, so 3 is accepted and 4 repeats 3
    rows = [row(1, 1, "a", "x", "F "), row(2, 2, TITLE, BODY, "f"), row(3, 3, TITLE, BODY), row(4, 4, TITLE + " x", BODY), row(5, 5, "b", "y", " "), row(6, 5, "c", "z", "")]
    assert run(spark, [scan(i) for i in range(1, 6)], rows) == [(1, 2), (3, 4)]


def test_one_time_and_redeliveries(spark):
    rows = [row(2, 1, TITLE, BODY), row(1, 2, TITLE, BODY), row(1, 2, TITLE, BODY), row(7, 3, TITLE, BODY)]
    assert run(spark, [scan(1, hours=5), scan(2, hours=5), scan(2, hours=5), scan(3)], rows) == [(1, 7), (2, 7)]
    assert run(spark, [scan(1, hours=1), scan(2, hours=1), scan(3)], rows) == [(1, 7)]


def test_missing_empty_and_long(spark):
    long = " ".join(f"Word{i} is here and there." for i in range(20_000))
    rows = [row(1, 1, None, None), row(2, 2, None, None), row(3, 1, "", long), row(4, 2, "", long + " More."), row(5, 9, TITLE, BODY)]
    assert run(spark, [scan(1), scan(2), ("b007", "batch", None, None, 1), ("b008", "full", T0, ("u",), 1)], rows) == [(1, 2), (3, 4)]
    assert run(spark, [], []) == []
    assert run(spark, [scan(1)], []) == []


def corpus(seed, n, batch_count):
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(60)]
    stock = "Results of this rule are reviewed by the owning team in time."
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.4:
            title, sents = made[rng.randrange(len(made))]
            sents = [s.split() for s in sents]
            rng.shuffle(sents)
            if rng.random() < 0.5:
                s = rng.choice(sents)
                s[rng.randrange(len(s))] = rng.choice(word)
            title, sents = title, [" ".join(s) for s in sents]
        else:
            title = " ".join(rng.sample(word, 6))
            sents = [" ".join(rng.sample(word, 14)) for _ in range(rng.randrange(2, 4))]
            made.append((title, sents))
        text = ". ".join(s.capitalize() for s in sents) + ". " + (stock if rng.random() < 0.5 else "")
        rows.append(row(i, rng.randrange(batch_count), title, text if rng.random() < 0.5 else text.upper(), rng.choice([None, None, f"p{rng.randrange(n)}"])))
    return rows


def brute(spark, scans, rows):
    """In order of time: a record repeats the accepted ones that it matches; one per fingerprint and per text."""
    return brute_of([r.asDict() for r in batches.records(spark.createDataFrame(scans, SCANS), spark.createDataFrame(rows, ROWS)).collect()])


def brute_of(parsed):
    accepted, out, waiting = [], set(), []
    for r in sorted(parsed, key=lambda r: (r["at"], r["rec_id"])):
        if waiting and waiting[0]["at"] != r["at"]:
            accepted += waiting
            waiting = []
        hits = {}
        for a in accepted:
            if a["repo"] == r["repo"]:
                if a["print"] and a["print"] == r["print"]:
                    hits.setdefault("print", a["rec_id"])
                if batches.say_the_same(a["title"], a["body"], r["title"], r["body"]):
                    hits.setdefault((a["title"], tuple(a["body"])), a["rec_id"])
        out |= {(min(x, r["rec_id"]), max(x, r["rec_id"])) for x in hits.values()}
        if not hits:
            waiting.append(r)
    return sorted(out)


def test_random_corpus_and_index(spark, tmp_path):
    scans = [scan(i, repo=f"o/r{i % 2}") for i in range(8)]
    rows = corpus(11, 160, 8)
    want = brute(spark, scans, rows)
    assert len(want) > 30
    assert run(spark, scans, rows, 2) == want
    index = batches.SegmentIndex(spark, str(tmp_path / "index"))
    found = set()
    for part in (scans[:3], scans[3:4], scans[4:]):
        batch = batches.records(spark.createDataFrame(part, SCANS), spark.createDataFrame(rows, ROWS))
        found |= {(r.id_a, r.id_b) for r in index.check(batch).collect()}
    assert sorted(found) == want


def test_small_data_against_comparing_all(spark):
    folder = "/root/testdata/sf0.01"
    scans, rows = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("scans", "batch_findings"))
    got = sorted((r.id_a, r.id_b) for r in batches.repeats(scans, rows).collect())
    assert len(got) > 300 and got == brute_of([r.asDict() for r in batches.records(scans, rows).collect()])


def test_long_texts_are_verified_in_time():
    rng = random.Random(2)
    began = time.monotonic()
    one = " ".join(f"w{rng.randrange(3000)}" for _ in range(30_000))  # one sentence without an end
    words = one.split()
    for _ in range(2000):
        words[rng.randrange(len(words))] = "x"
    assert batches.say_the_same("t", [one], "t", [" ".join(words[5000:] + words[:5000])])
    assert not batches.say_the_same("t", [one], "t", [" ".join(reversed(words))])
    same = "again and again the same line stands here"
    assert batches.say_the_same("t", [" ".join([same] * 4000)], "t", [" ".join([same] * 3900)])
    listed = [f"row {i} is here and there" for i in range(4000)]
    assert batches.say_the_same("t", sorted(listed), "t", sorted(x.replace("and", "or") for x in listed))
    assert time.monotonic() - began < 60


def test_failed_and_repeated_delivery(spark, tmp_path, monkeypatch):
    batch = lambda *rows: batches.records(spark.createDataFrame([scan(i) for i in range(1, 4)], SCANS), spark.createDataFrame(rows, ROWS))
    index = batches.SegmentIndex(spark, str(tmp_path / "index"))
    first, second = row(1, 1, TITLE, BODY), row(2, 2, TITLE, BODY + " See it.")
    assert index.check(batch(first)).count() == 0
    with monkeypatch.context() as m:
        m.setattr(index, "_store", lambda df, name, number: 1 / 0 if name == "seen" else batches.SegmentIndex._store(index, df, name, number))
        try:
            index.check(batch(row(5, 2, "Another title of five words", "x y z")))
        except ZeroDivisionError:
            pass
    assert [tuple(r) for r in index.check(batch(second, row(5, 2, "Another title of five words", "x y z"))).collect()] == [(1, 2)]
    assert index.check(batch(first, second)).count() == 0  # checked before
    assert [tuple(r) for r in index.check(batch(row(6, 3, "Another title of five words", "X y z"))).collect()] == [(5, 6)]


def test_order_of_words_counts():
    assert not batches.say_the_same("t", ["a calls b"], "t", ["b calls a"])
    assert batches.say_the_same("t", ["one two three four five", "six seven eight nine"], "t", ["six seven eight ten one two three four five"])


def test_reworded_copies_of_one_record(spark):
    # the sentences that all share are common, the rare ones are reworded in three words each
    same = ["the eager registry duplicates a forked plugin under load while one branch sleeps", "an attacker with a legacy scheduler sees how one cursor trusts sealed namespace values"]
    rows = [row(i, i, TITLE, ". ".join(s.capitalize() for s in [*same, f"when a router{i} arrives silently this partial credential{i} forwards every stale column{i} twice and late"])) for i in range(50)]
    assert run(spark, [scan(i) for i in range(50)], rows) == [(0, i) for i in range(1, 50)]


def test_many_variants_of_one_title(spark):
    # titles without description, another word at the end of each, in several batches
    for n in (300, 6000):
        rows = [row(i, min(i, 1) + i % 2, f"Image holds the outdated package lib{i}", None) for i in range(n)]
        assert run(spark, [scan(0), scan(1), scan(2)], rows) == [(0, i) for i in range(1, n)]


def test_reworded_where_no_sentence_survives(spark):
    body = "The eager registry duplicates a forked plugin under load while one branch sleeps at night"
    rows = [row(1, 1, TITLE, body), row(2, 2, TITLE, body.replace("eager", "idle").replace("branch", "mutex")), row(3, 3, "Stale lock held by zuge worker", None), row(4, 4, "Stale key held by mohu worker", "")]
    assert run(spark, [scan(i) for i in range(1, 5)], rows) == [(1, 2), (3, 4)]


def test_candidates_miss_no_pair(spark):
    rng = random.Random(5)
    titles = []
    for _ in range(120):
        t = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 34))]
        titles.append(" ".join(t))
        for _ in range(2):
            for _ in range(rng.randrange(0, 2 + int(0.3 * len(t)))):
                t.insert(rng.randrange(len(t) + 1), "x") if rng.random() < 0.3 or not t else t.pop(rng.randrange(len(t))) if rng.random() < 0.5 else t.__setitem__(rng.randrange(len(t)), "y")
            titles.append(" ".join(t))
    words = "one body of several words that is nearly the same each time".split()
    bodies = [" ".join(words[i % 4 :]) for i in range(len(titles))]
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if batches.say_the_same(titles[i], [bodies[i]], titles[j], [bodies[j]])}
    texts = spark.createDataFrame([(1, i, t, [b]) for i, (t, b) in enumerate(zip(titles, bodies, strict=True))], "repo long, text long, title string, body array<string>")
    assert len(want) > 100
    found = batches.entries(texts)
    assert want <= {tuple(sorted((r.text_a, r.text_b))) for r in batches.candidates(found.where("own"), found.where("not own")).collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7), st.integers(0, 8))
def test_edit_distance(a, b, most):
    full = list(range(len(b) + 1))
    for x in a:
        last, full[0] = full[0], full[0] + 1
        for j, y in enumerate(b, 1):
            last, full[j] = full[j], min(last + (x != y), full[j] + 1, full[j - 1] + 1)
    assert batches.edit_distance(a, b, most) == min(full[-1], most + 1)
