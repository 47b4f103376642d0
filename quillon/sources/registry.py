"""Scanner adapters and their registry."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from quillon.schema import scan_ddl
from quillon.sources.process import ProcessOutput, run_process

Runner = Callable[..., ProcessOutput]

#: Limits in seconds and the arguments of the built-in scanner.
PROBE_TIMEOUT_S = 10
SCAN_TIMEOUT_S = 600
SCAN_ARGUMENTS = ("fs", "--format", "json", "--scanners", "vuln,secret,misconfig")
PROBE_FAILED = "Trivy returned a non-zero exit code."
CAPABILITIES_OF_BUILT_IN = ("dependency", "secret", "iac", "container")


@dataclass(frozen=True)
class Availability:
    available: bool
    version: str | None = None
    reason: str | None = None


@dataclass(frozen=True)
class RawScan:
    """The report of one run, not yet parsed."""

    scanner: str
    started_at: datetime
    completed_at: datetime
    target: str
    raw: str
    diagnostics: list[str]


class ScannerAdapter(Protocol):
    id: str
    display_name: str
    capabilities: tuple[str, ...]

    def check_availability(self) -> Availability: ...

    def scan(self, target: str, timeout_s: float | None = None, cancel: threading.Event | None = None) -> RawScan: ...


@dataclass
class CommandScanner:
    """A scanner that prints a JSON report."""

    id: str = "trivy"
    display_name: str = "Trivy"
    capabilities: tuple[str, ...] = CAPABILITIES_OF_BUILT_IN
    command: str = "trivy"
    run: Runner = run_process

    def _said(self, arguments: list[str], timeout_s: float, **more: object) -> tuple[ProcessOutput, str]:
        """What the command printed, and its trimmed complaint."""
        output = self.run(self.command, arguments, timeout_s=timeout_s, **{k: v for k, v in more.items() if v is not None})
        return output, output.stderr.strip()

    def check_availability(self) -> Availability:
        """Ask for the version. All trimmed output counts as the version."""
        try:
            output, complaint = self._said(["--version"], PROBE_TIMEOUT_S)
        except OSError as error:
            return Availability(False, reason=str(error))
        good = output.exit_code == 0
        return Availability(good, output.stdout.strip() if good else None, None if good else complaint or PROBE_FAILED)

    def scan(self, target: str, timeout_s: float | None = None, cancel: threading.Event | None = None) -> RawScan:
        """Scan a folder; a non-zero exit raises RuntimeError. ``cancel`` ends it early, which counts as such an exit."""
        started = datetime.now(UTC)
        output, complaint = self._said([*SCAN_ARGUMENTS, target], SCAN_TIMEOUT_S if timeout_s is None else timeout_s, cancel=cancel)
        if output.exit_code != 0:
            raise RuntimeError(f"{self.id} ended with exit code {output.exit_code} on {target}: {complaint}")
        return RawScan(self.id, started, datetime.now(UTC), target, output.stdout, [complaint] if complaint else [])


def built_in_scanners() -> list[ScannerAdapter]:
    """The scanners in the order in which they run."""
    return [CommandScanner()]


def availability_rows(spark: SparkSession, scanners: list[ScannerAdapter]) -> DataFrame:
    """scanner_seq, id, display_name, available, version, reason of each scanner, probed one after another."""
    rows = [(i, s.id, s.display_name, *(lambda a: (a.available, a.version, a.reason))(s.check_availability())) for i, s in enumerate(scanners)]
    return spark.createDataFrame(rows, "scanner_seq int, id string, display_name string, available boolean, version string, reason string")


def run_scanners(spark: SparkSession, scanners: list[ScannerAdapter], target: str, timeout_s: float | None = None, cancel: threading.Event | None = None) -> tuple[DataFrame, DataFrame]:
    """Run all in series: reports (scan_id, scanner_seq, raw) and headers in the scan schema. Any failure ends the scan."""
    done = [s.scan(target, timeout_s, cancel) for s in scanners]
    scan_id = f"{target}@{done[0].started_at.isoformat()}" if done else target
    reports = spark.createDataFrame([(scan_id, i, r.raw) for i, r in enumerate(done)], "scan_id string, scanner_seq int, raw string")
    headers = spark.createDataFrame(
        [(i, scan_id, r.scanner, r.started_at, r.completed_at, (r.target, None, None, None), r.diagnostics) for i, r in enumerate(done)],
        f"scanner_seq int, {scan_ddl()}",
    )
    return reports, headers
