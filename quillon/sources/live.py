"""A Spark data source over a scanner command: each path is scanned in a task of its own.

    spark.dataSource.register(ScannerReports)
    spark.read.format("scanner_reports").option("paths", "/a,/b").option("command", "trivy").load()
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.sources.registry import CommandScanner


class _Target(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.command = options.get("command", "trivy")
        self.timeout_s = float(options["timeout_s"]) if "timeout_s" in options else None
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Target(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        done = CommandScanner(command=self.command).scan(partition.path, self.timeout_s)
        yield (done.target, 0, done.raw, done.diagnostics)


class ScannerReports(DataSource):
    """Reports of live scans: scan_id (the path), scanner_seq, raw, diagnostics."""

    @classmethod
    def name(cls) -> str:
        return "scanner_reports"

    def schema(self) -> str:
        return "scan_id string, scanner_seq int, raw string, diagnostics array<string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))
