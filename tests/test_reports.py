"""Report normalisation, report sinks, sources and the command line."""

import json
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.functions.text import pad_end, trim_blanks
from quillon.operators import correlate, normalize
from quillon.plans import report
from quillon.sources import live, reports
from quillon.sources.process import ProcessOutput, run_process
from quillon.sources.registry import Availability, CommandScanner, availability_rows
from quillon.streaming import reports as streams


def parse(spark, *docs):
    rows = [(f"s{i}", d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return normalize.findings(spark.createDataFrame(rows, "scan_id string, raw string")).orderBy("scan_id", "ord").collect()


def test_roots_without_findings(spark):
    assert parse(spark, "[]", "5", "null", "{}", '{"Results":{}}', "", None, "{", '{"Results":[]} x', "NaN", "'a'", '{"Results":[null,3,"x"]}') == []


def test_items_that_are_no_objects(spark):
    doc = {"Results": [{"Target": "p", "Vulnerabilities": [7, None, [1], {"VulnerabilityID": 5, "Title": {}}]}]}
    rows = parse(spark, doc)
    assert [r.title for r in rows] == ["Dependency vulnerability"] * 2
    assert [r.scanner.rule_id for r in rows] == [None, None]
    assert [r.ord.item_pos for r in rows] == [2, 3]


def test_dependency_fields(spark):
    items = [
        {"VulnerabilityID": "GHSA-x", "Title": "", "PkgName": "", "FixedVersion": "2", "Severity": " HIGH"},
        {"VulnerabilityID": "C-1", "PkgName": "pkg", "FixedVersion": "", "Severity": "Negligible", "InstalledVersion": "1", "PrimaryURL": "u"},
        {"FixedVersion": "3", "Severity": "CRITICAL", "Description": "d"},
    ]
    a, b, c = parse(spark, {"Results": [{"Target": "", "Vulnerabilities": items}]})
    assert (a.title, a.remediation, a.severity, a.identifiers.cve, a.location) == ("", "Upgrade  to 2 or later.", "unknown", ["GHSA-x"], None)
    assert (b.title, b.remediation, b.severity) == ("C-1 in pkg", None, "unknown")
    assert json.loads(b.metadata) == {"package": "pkg", "installedVersion": "1", "fixedVersion": "", "primaryUrl": "u"}
    assert (c.title, c.remediation, c.severity, c.identifiers, c.description) == ("Dependency vulnerability", "Upgrade the affected dependency to 3 or later.", "critical", None, "d")
    assert {a.confidence, b.confidence, c.confidence} == {0.95}


def test_secret_and_misconfiguration_fields(spark):
    doc = {"Results": [{
        "Target": "t",
        "Misconfigurations": [{"AVDID": "M", "Message": "m", "Resolution": "r", "Namespace": "n", "Severity": "low"}, {}],
        "Secrets": [{"RuleID": "S", "StartLine": 3.0, "Match": "x", "Category": "c"}, {"StartLine": 0}, {"StartLine": "4"}, {"StartLine": 3.5}],
    }]}
    rows = parse(spark, doc)
    assert [(r.category, r.title) for r in rows] == [("secret", "S")] + [("secret", "Potential secret detected")] * 3 + [("misconfiguration", "M"), ("misconfiguration", "Configuration issue")]
    assert [r.location.start_line for r in rows] == [3, None, None, None, None, None]
    assert (rows[0].evidence, rows[0].description, rows[4].description, rows[4].remediation) == ("x", "c", "m", "r")
    assert rows[0].metadata is None and json.loads(rows[4].metadata) == {"namespace": "n"}
    assert len({r.id for r in rows}) == 6


def test_repeated_keys_and_order(spark):
    (r,) = parse(spark, '{"Results":[{"Target":"t","Secrets":[{"RuleID":"a","RuleID":"b"}]}]}')
    assert r.scanner.rule_id == "b"
    df = spark.createDataFrame([("s", 1, '{"Results":[{"Secrets":[{}]}]}'), ("s", 0, '{"Results":[{"Secrets":[{}]},{"Vulnerabilities":[{}],"Secrets":[{}]}]}')], "scan_id string, scanner_seq int, raw string")
    assert [tuple(r.ord) for r in normalize.findings(df).orderBy("ord").collect()] == [(0, 0, 1, 0), (0, 1, 0, 0), (0, 1, 1, 0), (1, 0, 1, 0)]


def test_strict_and_diagnostics(spark):
    df = spark.createDataFrame([("s", "{")], "scan_id string, raw string")
    assert [r.problem for r in normalize.parsed(df)[1].collect()] == ["report is no valid JSON"]
    with pytest.raises(Exception, match="MALFORMED"):
        normalize.findings(df, strict=True).collect()


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t\n a﻿ ",), ("\u0085b",), ("longer than that",), ("",)], "t string")
    assert [r.x for r in df.select(trim_blanks(F.col("t")).alias("x")).collect()] == ["a", "\u0085b", "longer than that", ""]
    assert [r.x for r in df.select(pad_end(trim_blanks(F.col("t")), 3).alias("x")).collect()] == ["a  ", "\u0085b ", "longer than that", "   "]


DOC = {"Results": [{"Target": "a/b", "Secrets": [{"RuleID": "R", "StartLine": 4, "Severity": "HIGH"}, {"RuleID": "R", "StartLine": 4, "Severity": "LOW"}], "Vulnerabilities": [{"VulnerabilityID": "C", "FixedVersion": "2"}]}]}


def test_report_sinks(spark):
    df = normalize.findings(spark.createDataFrame([("s", json.dumps(DOC))], "scan_id string, raw string"))
    groups = correlate.correlated(df)
    lines = [r.lines for r in report.text_report(groups).collect()]
    assert lines[0].startswith("[HIGH] R\n  a/b:4\n  source: trivy / R\n  fix: Revoke")
    assert lines[1] == "[UNKNOWN] C\n  a/b\n  source: trivy / C\n  fix: Upgrade the affected dependency to 2 or later.\n"
    body = json.loads("".join(report.json_document(groups, "/t", ["trivy"], 3)))
    assert json.loads("".join(report.json_document(groups.limit(0), "/t", [], 0)))["findings"] == []
    assert list(body) == ["target", "scanners", "rawFindingCount", "correlatedFindingCount", "findings"]
    assert (body["rawFindingCount"], body["correlatedFindingCount"]) == (3, 2)
    first = body["findings"][0]
    assert first["primary"]["location"] == {"path": "a/b", "startLine": 4} and first["sources"] == [{"name": "trivy", "ruleId": "R"}]
    assert len(first["duplicates"]) == 1 and "identifiers" not in first["primary"] and "fingerprint" not in first["primary"]
    assert body["findings"][1]["primary"]["metadata"] == {"fixedVersion": "2"}


def test_location_text(spark):
    df = spark.createDataFrame([(None,), (("p", 0),), (("p", 7),)], "l struct<path:string,start_line:bigint>")
    assert [r.x for r in df.select(report.location_text(F.col("l")).alias("x")).collect()] == ["repository", "p", "p:7"]


def test_process():
    done = run_process(sys.executable, ["-c", "import sys; print('ü'); sys.exit(3)"])
    assert (done.exit_code, done.stdout) == (3, "ü\n")
    assert run_process(sys.executable, ["-c", "import time; time.sleep(30)"], timeout_s=0.3).exit_code == -1
    with pytest.raises(OSError):
        run_process("/no/such/command", [])
    stop = threading.Event()
    threading.Timer(0.3, stop.set).start()
    began = time.monotonic()
    assert run_process(sys.executable, ["-c", "import time; time.sleep(30)"], cancel=stop).exit_code == -1
    assert run_process(sys.executable, ["-c", "import time; time.sleep(30)"], cancel=stop).exit_code == -1  # set before
    assert time.monotonic() - began < 10
    assert run_process(sys.executable, ["-c", "print(1)"], cancel=threading.Event()).stdout == "1\n"


class Fake:
    def __init__(self, version=(0, " 1.0\nx ", ""), scan=(0, json.dumps(DOC), " note ")):
        self.answers = {"--version": version, "fs": scan}

    def __call__(self, command, arguments, timeout_s=None, cancel=None):
        answer = self.answers[arguments[0]]
        if isinstance(answer, Exception):
            raise answer
        return ProcessOutput(*answer)


def test_scanner(spark):
    assert CommandScanner(run=Fake()).check_availability() == Availability(True, version="1.0\nx")
    assert CommandScanner(run=Fake((1, "", " why "))).check_availability().reason == "why"
    assert CommandScanner(run=Fake((1, "", ""))).check_availability().reason == "Trivy returned a non-zero exit code."
    assert CommandScanner(run=Fake(OSError("gone"))).check_availability().reason == "gone"
    assert CommandScanner(run=Fake()).scan("/x").diagnostics == ["note"]
    with pytest.raises(RuntimeError, match=r"code 2 .*: bad"):
        CommandScanner(run=Fake(scan=(2, "", "bad\n"))).scan("/x")
    rows = availability_rows(spark, [CommandScanner(run=Fake()), CommandScanner(run=Fake(OSError("gone")))])
    assert [r.line for r in report.availability_lines(rows).collect()] == ["OK       Trivy              1.0\nx", "MISSING  Trivy              gone"]


def test_command_line(spark, tmp_path, capsys):
    good = [CommandScanner(run=Fake())]
    assert cli.main([], good) == 0 and cli.main(["--help"], good) == 0 and cli.main(["what"], good) == 1
    assert cli.main(["scan"], good) == 1 and cli.main(["scan", "--json"], good) == 1 and cli.main(["scan", str(tmp_path / "none")], good) == 1
    assert cli.main(["doctor"], good) == 0
    capsys.readouterr()
    assert cli.main(["scan", str(tmp_path), "--json"], good) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["correlatedFindingCount"] == 2 and "scanning" not in said.err
    assert cli.main(["scan", str(tmp_path)], [*good, CommandScanner(run=Fake(OSError("gone")))]) == 0
    said = capsys.readouterr()
    assert "2 correlated finding(s) (3 raw)" in said.out and "Trivy: left out, gone" in said.err
    assert cli.main(["scan", str(tmp_path)], [CommandScanner(run=Fake(OSError("gone")))]) == 1
    assert cli.main(["scan", str(tmp_path)], [CommandScanner(run=Fake(scan=(1, "", "x")))]) == 1


def test_report_files_and_live_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC, indent=2))
    assert normalize.findings(reports.report_files(spark, str(tmp_path))).count() == 3
    tool = tmp_path / "tool.sh"
    tool.write_text(f"#!/bin/sh\ncat {tmp_path}/a.json\n")
    tool.chmod(0o755)
    spark.dataSource.register(live.ScannerReports)
    read = spark.read.format("scanner_reports").option("paths", "/a,/b").option("command", str(tool)).load()
    assert {r.scan_id for r in read.collect()} == {"/a", "/b"} and normalize.findings(read).count() == 6


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOC))
    found = streams.finding_stream(streams.report_stream(spark, str(tmp_path / "in")))
    query = streams.primary_stream(found).writeStream.outputMode("complete").format("memory").queryName("primaries").start()
    try:
        query.processAllAvailable()
        assert {(r.primary.title, r.members) for r in spark.sql("select * from primaries").collect()} == {("R", 2), ("C", 1)}
    finally:
        query.stop()
