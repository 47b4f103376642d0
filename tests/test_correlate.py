"""Fingerprints and correlation: the edge cases, and random findings against the fold."""

import random

from fold import correlate as fold
from fold import identity

from quillon.functions.fingerprint import finding_fingerprint
from quillon.operators import correlate
from quillon.schema import finding_ddl


def finding(i, **more):
    base = {
        "scan_id": "s", "ord": {"scanner_seq": 0, "result_pos": i, "class_rank": 0, "item_pos": 0}, "id": str(i), "title": "T", "description": None, "category": "sast", "severity": "high", "confidence": 0.5,
        "scanner": {"name": "n", "version": None, "rule_id": "r"}, "location": None, "identifiers": None, "evidence": None, "remediation": None, "fingerprint": None, "metadata": None,
    }
    return base | more


def frame(spark, rows):
    return spark.createDataFrame(rows, finding_ddl())


def nested(spark, rows):
    got = correlate.ranked(correlate.correlated(frame(spark, rows))).collect()
    return [(r.fingerprint, r.primary.id, [d.id for d in r.duplicates], [(s.name, s.version, s.rule_id) for s in r.sources]) for r in got]


def model(rows):
    return [(g["fingerprint"], g["primary"]["id"], [d["id"] for d in g["duplicates"]], [(s["name"], s["version"], s["rule_id"]) for s in g["sources"].values()]) for g in fold(rows)]


def test_two_scanners(spark):
    base = {"category": "dependency", "location": {"path": "package-lock.json"}, "identifiers": {"cve": ["CVE-2026-1234"]}, "title": "Example vulnerable dependency"}
    rows = [
        finding(0, **base, confidence=0.8, scanner={"name": "trivy", "version": None, "rule_id": "CVE-2026-1234"}),
        finding(1, **base, confidence=0.95, scanner={"name": "grype", "version": None, "rule_id": "CVE-2026-1234"}),
    ]
    (group,) = nested(spark, rows)
    assert group[0] == "ce352903df945d2f3f88ed4ccccdb915ca32028cd98989b77fb4f396416114df"
    assert group[1:] == ("1", ["0"], [("trivy", None, "CVE-2026-1234"), ("grype", None, "CVE-2026-1234")])


def same(spark, a, b):
    """Whether two findings share a fingerprint."""
    prints = [r.f for r in frame(spark, [finding(0, **a), finding(1, **b)]).select(finding_fingerprint().alias("f")).collect()]
    assert prints == [identity(finding(0, **a)), identity(finding(1, **b))]
    return prints[0] == prints[1]


def test_identity(spark):
    at = lambda path, line=None: {"location": {"path": path, "start_line": line}}
    rule = lambda r: {"scanner": {"name": "n", "rule_id": r}}
    ids = lambda **k: {"identifiers": k}
    assert same(spark, {"fingerprint": "k", "title": "a"}, {"fingerprint": "k", "title": "b"})
    assert same(spark, {"fingerprint": ""}, {})
    assert same(spark, rule(None), rule(""))
    assert not same(spark, at("p", 0), at("p"))
    assert not same(spark, ids(cve=["x", "x"]), ids(cve=["x"]))
    assert same(spark, ids(cwe=["x"]), ids(cve=["x"]))
    assert same(spark, ids(cve=["b", "a"]), ids(cve=[" A", "B"]))
    assert same(spark, rule("a|b") | at("c"), rule("a") | at("b|c"))
    assert same(spark, at("SRC/A"), at("src/a"))
    assert not same(spark, at(" src/a"), at("src/a"))
    assert same(spark, {"title": "\t T﻿"}, {"title": "t"})
    assert not same(spark, {"title": "T\u0085"}, {"title": "T"})
    assert not same(spark, rule("R1"), rule("r1"))


def test_order_of_duplicates(spark):
    level = lambda i, s, c: finding(i, severity=s, confidence=c)
    for rows, primary, duplicates in (
        ([level(0, "high", 0.9), level(1, "high", 0.9)], "0", ["1"]),
        ([level(0, "high", 0.8), level(1, "high", 0.95), level(2, "critical", 0.1), level(3, "low", 1.0)], "2", ["0", "1", "3"]),
        ([level(0, "high", 0.9), level(1, "low", 0.5), level(2, "critical", 0.1)], "2", ["1", "0"]),
    ):
        (group,) = nested(spark, rows)
        assert group[1:3] == (primary, duplicates)


def test_source_keys_may_collide(spark):
    rows = [finding(0, fingerprint="k", scanner={"name": "a:b", "version": "1", "rule_id": "c"}), finding(1, fingerprint="k", scanner={"name": "a", "version": "2", "rule_id": "b:c"})]
    assert nested(spark, rows)[0][3] == [("a:b", "1", "c")]
    assert correlate.sources(frame(spark, rows)).count() == 1


def test_random_against_the_fold(spark):
    rng = random.Random(7)
    rows = [
        finding(i, title=rng.choice(["t", "T ", "u"]), category=rng.choice(["sast", "iac"]), severity=rng.choice(["critical", "high", "medium", "low", "info", "unknown"]), confidence=rng.randrange(5) / 4,
                fingerprint=rng.choice([None, "", "fix"]), scanner={"name": rng.choice("ab"), "version": rng.choice(["1", None]), "rule_id": rng.choice([None, "", "r"])})
        for i in range(600)
    ]
    want = model(rows)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert nested(spark, shuffled) == want
    df = frame(spark, shuffled)
    assert {(r.group_fingerprint, r.primary.id, r.members, r.sources) for r in correlate.summary(df).collect()} == {(f, p, len(d) + 1, len(s)) for f, p, d, s in want}
    flat = correlate.members(df)
    assert {r.id for r in flat.where("role = 'primary'").collect()} == {p for _, p, _, _ in want}
    assert [r.groups for r in correlate.counts(df).collect()] == [len(want)]


def test_empty_and_scopes(spark):
    assert nested(spark, []) == []
    assert correlate.members(frame(spark, [])).count() == 0
    rows = [finding(0), finding(1, scan_id="other")]
    assert len(nested(spark, rows)) == 2


def test_ingest_guard(spark):
    rows = [finding(0), finding(1, confidence=float("nan")), finding(2, confidence=None), finding(3, severity="dire"), finding(4, title=None), finding(5, scanner=None)]
    good, bad = correlate.accepted(frame(spark, rows))
    assert [r.id for r in good.collect()] == ["0"] and bad.count() == 5


def test_groups_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(correlate, "LARGE", 100)
    # two groups over eight ranges, so each has parts without its first record, its last one, or a new source
    rng = random.Random(3)
    rows = [finding(i, title=rng.choice("AAABBBCD"), severity=rng.choice(["low", "high", "critical"]), confidence=rng.randrange(0, 1 + i // 3) / 200, scanner={"name": f"n{rng.randrange(1 + i // 40)}", "version": None, "rule_id": "r"}) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, ends = correlate._parted(correlate.prepared(frame(spark, rows)), correlate.GROUP, "position")
        assert placed.select("part").distinct().count() > 4 and ends.count() > 300
        assert correlate._large(correlate.prepared(frame(spark, rows)), correlate.GROUP).count() == 2
        assert nested(spark, rows) == model(rows)
        many = [finding(i, title=str(i), confidence=rng.randrange(9) / 9, scan_id=rng.choice("aaab")) for i in range(300)]
        ranks = correlate.group_rank(correlate.summary(frame(spark, many))).collect()
        for scan in "ab":
            mine = sorted((r for r in ranks if r.scan_id == scan), key=lambda r: (-r.primary.confidence, r.first_position))
            assert [r.group_rank for r in mine] == list(range(1, len(mine) + 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
