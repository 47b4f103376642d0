"""Command line: ``doctor``, ``scan FOLDER [--json]``, ``help``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quillon.operators.correlate import correlated
from quillon.operators.normalize import findings
from quillon.plans import report
from quillon.session import configure, staged
from quillon.sources.registry import ScannerAdapter, availability_rows, built_in_scanners, run_scanners
from quillon.sources.reports import checked_target

HELP = """quillon doctor                 list the scanners and whether they can run
quillon scan FOLDER [--json]   run every scanner that can on FOLDER; print the findings as text or JSON
quillon help                   this text
"""


def _session() -> SparkSession:
    return configure(SparkSession.builder.appName("quillon").getOrCreate())


def doctor(scanners: list[ScannerAdapter]) -> None:
    print("Scanners:\n")
    for row in report.availability_lines(availability_rows(_session(), scanners)).toLocalIterator():
        print(row.line)


def scan(arguments: list[str], scanners: list[ScannerAdapter]) -> None:
    target = checked_target(arguments[0] if arguments else None)
    as_json = "--json" in arguments
    say = (lambda *x: None) if as_json else (lambda *x: print(*x, file=sys.stderr))
    available = []
    for scanner in scanners:
        status = scanner.check_availability()
        if status.available:
            available.append(scanner)
            say(f"{scanner.display_name}: scanning {target}")
        else:
            say(f"{scanner.display_name}: left out, {status.reason or 'it is missing'}")
    if not available:
        raise RuntimeError("none of the scanners can run; see quillon doctor")
    spark = _session()
    reports, headers = run_scanners(spark, available, target)
    for header in report.header_lines(headers).toLocalIterator():
        say(f"{header.scanner}: from {header.started}, {header.diagnostics} diagnostic(s)")
    found = staged(findings(reports, strict=True))
    groups = staged(correlated(found))
    raw = found.count()
    if as_json:
        for part in report.json_document(groups, target, [s.id for s in available], raw):
            print(part, end="")
        print()
        return
    print(f"\n{report.summary_line(groups.count(), raw)}\n")
    for row in report.text_report(groups).toLocalIterator():
        print(row.lines)


def main(arguments: list[str], scanners: list[ScannerAdapter] | None = None) -> int:
    """Run a command; returns the exit code. Findings don't affect it."""
    scanners = built_in_scanners() if scanners is None else scanners
    command, *rest = arguments or ["help"]
    try:
        if command == "doctor":
            doctor(scanners)
        elif command == "scan":
            scan(rest, scanners)
        else:
            print(HELP)
            return 0 if command in ("help", "--help", "-h") else 1
    except Exception as error:  # noqa: BLE001
        print(f"failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
