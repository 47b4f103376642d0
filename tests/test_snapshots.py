"""Snapshot changes against comparing whole snapshots."""

import random
import shutil
from datetime import datetime, timedelta

from quillon.operators import snapshots

SCANS = "scan_id string, feed string, completed_at timestamp, target struct<path:string,repository_url:string,commit_sha:string,branch:string>, key string"
ROWS = "scan_id string, fingerprint string, title string, severity string, confidence double, location struct<path:string,start_line:bigint>, remediation string, leaf int"
T0 = datetime(2040, 1, 1)


def scan(i, url="https://h.example/o/r", sha=None, branch="main", feed="full", done=True):
    return (f"s{i:03d}", feed, T0 + timedelta(hours=i) if done else None, (None, url, sha or f"{i:040x}", branch), "k")


def row(i, fp, title="t", conf=0.5, path="p", line=1, fix=None):
    return (f"s{i:03d}", fp, title, "low", conf, None if path is None else (path, line), fix, 7)


def run(spark, scans, rows, **options):
    got = snapshots.changes(spark.createDataFrame(scans, SCANS), spark.createDataFrame(rows, ROWS), **options).collect()
    return sorted((r.scan_id, r.fingerprint, r.kind) for r in got)


def test_kinds(spark):
    rows = [row(1, "a"), row(1, "b"), row(1, "c", conf=0.5), row(2, "A "), row(2, "b", title="u"), row(2, "c", conf=0.50000001), row(2, "d"), row(2, None), row(2, " ")]
    assert run(spark, [scan(1), scan(2)], rows) == [("s002", "b", "changed"), ("s002", "d", "added")]
    rows = [row(1, "a"), row(1, "b", path=None), row(2, "b", path=None, fix="f")]
    assert run(spark, [scan(1), scan(2)], rows) == [("s002", "a", "removed"), ("s002", "b", "changed")]


def test_nulls_in_other_fields_are_told_apart(spark):
    rows = [row(1, "a", title=None, fix="x"), row(2, "a", title="x", fix=None), row(1, "b", conf=float("nan")), row(2, "b", conf=None), row(1, "c", conf=0.0), row(2, "c", conf=-0.0)]
    assert run(spark, [scan(1), scan(2)], rows) == [("s002", "a", "changed")]


def test_empty_snapshots(spark):
    assert run(spark, [scan(1), scan(2), scan(3)], [row(1, "a"), row(3, "b")]) == [("s002", "a", "removed"), ("s003", "b", "added")]
    assert run(spark, [], []) == []
    assert run(spark, [scan(1)], [row(1, "a")]) == []


def test_which_scans_count(spark):
    sha = "ab" * 20
    scans = [scan(1), scan(2, sha=sha), scan(3, sha=sha.upper() + " "), scan(4, sha=sha[:12]), scan(5, done=False), scan(6, feed="scan"), scan(7, url="git@H.example:O/R.git"), scan(8, branch="dev"), scan(9, url=None), scan(7, url="git@H.example:O/R.git")]
    rows = [row(i, f"f{i}") for i in range(1, 10)]
    assert run(spark, scans, rows) == [("s004", "f1", "removed"), ("s004", "f4", "added"), ("s007", "f4", "removed"), ("s007", "f7", "added")]


def test_repeated_rows_and_long_texts(spark):
    long = "x" * 300_000
    rows = [row(1, "a", title=long)] * 3 + [row(2, "a", title=long)] + [row(1, "b", title="1"), row(1, "b", title="2"), row(2, "b", title="1")]
    assert run(spark, [scan(1), scan(2), scan(2)], rows) == []


def test_random_depths(spark):
    rng = random.Random(5)
    scans, rows, state, want = [], [], {}, []
    for i in range(1, 7):
        before = dict(state)
        for _ in range(40):
            fp = f"f{rng.randrange(400):04d}"
            if rng.random() < 0.3:
                state.pop(fp, None)
            else:
                state[fp] = rng.choice("xyz")
        if i == 4:
            state = before = dict(before)  # nothing changes
        scans.append(scan(i))
        rows += [row(i, f, title=t) for f, t in state.items()]
        if i > 1:
            want += [(f"s{i:03d}", f, "added") for f in state.keys() - before.keys()] + [(f"s{i:03d}", f, "removed") for f in before.keys() - state.keys()]
            want += [(f"s{i:03d}", f, "changed") for f in state.keys() & before.keys() if state[f] != before[f]]
    for per_leaf in (1, 8, 1000):
        assert run(spark, scans, rows, rows_per_leaf=per_leaf) == sorted(want)


def test_deliveries(spark, tmp_path):
    rng = random.Random(8)
    scans, rows = [], []
    for i in range(1, 10):
        scans.append(scan(i, branch=("main", "dev", None)[i % 3]))
        rows += [row(i, f"f{k}", title=rng.choice("xyyy")) for k in range(rng.randrange(40, 90)) if rng.random() < 0.9]
    want = run(spark, scans, rows)
    history = snapshots.SnapshotHistory(spark, str(tmp_path / "h"), rows_per_leaf=4)
    frames = lambda low, high: (spark.createDataFrame([s for s in scans if low <= int(s[0][1:]) <= high], SCANS), spark.createDataFrame([r for r in rows if low <= int(r[0][1:]) <= high], ROWS))
    got = []
    for low, high in ((1, 3), (4, 6), (7, 9)):
        if low == 7:  # the third delivery follows snapshots of the second only: no row of the first is needed
            shutil.rmtree(tmp_path / "h" / "rows" / "delivery=0")
        found = history.deliver(*frames(low, high))
        got += [(r.scan_id, r.fingerprint, r.kind) for r in found.collect()]
    assert len(want) > 100 and sorted(got) == want
    assert history.deliver(*frames(7, 9)).count() == 0  # delivered again


def test_late_header_and_rescan(spark, tmp_path):
    history = snapshots.SnapshotHistory(spark, str(tmp_path / "h"))
    frame = lambda data, ddl: spark.createDataFrame(data, ddl)
    told = lambda df: sorted((r.scan_id, r.fingerprint, r.kind) for r in df.collect())
    sha = "cd" * 20
    assert told(history.deliver(frame([scan(1), scan(4, sha=sha)], SCANS), frame([row(1, "a"), row(3, "c"), row(4, "b")], ROWS))) == [("s004", "a", "removed"), ("s004", "b", "added")]
    assert told(history.deliver(frame([scan(3)], SCANS), frame([], ROWS))) == [("s003", "a", "removed"), ("s003", "c", "added"), ("s004", "b", "added"), ("s004", "c", "removed")]
    assert told(history.deliver(frame([scan(5, sha=sha)], SCANS), frame([row(5, "c")], ROWS))) == []


def test_failed_delivery(spark, tmp_path, monkeypatch):
    history = snapshots.SnapshotHistory(spark, str(tmp_path / "h"))
    frames = spark.createDataFrame([scan(1), scan(2)], SCANS), spark.createDataFrame([row(1, "a"), row(2, "b")], ROWS)
    with monkeypatch.context() as m:
        m.setattr(history, "_commit", lambda number: 1 / 0)
        try:
            history.deliver(*frames)
        except ZeroDivisionError:
            pass
    assert history.deliver(*frames).count() == 2
