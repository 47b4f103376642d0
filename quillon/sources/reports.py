"""Report files, tables and in-memory findings as sources."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.schema import finding_ddl


def report_files(spark: SparkSession, paths: str | list[str], scanner_seq: int = 0) -> DataFrame:
    """One row per report file: scan_id (the file's path), scanner_seq, raw. Files are read whole and in parallel."""
    read = spark.read.text(paths, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("scan_id"), F.lit(scanner_seq).alias("scanner_seq"), F.col("value").alias("raw"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_memory(spark: SparkSession, rows: Iterable[Row | tuple | dict]) -> DataFrame:
    """Findings given as rows in the finding schema; ``ord`` carries their order."""
    return spark.createDataFrame(list(rows), finding_ddl())


def checked_target(argument: str | None) -> str:
    """The absolute path of a scan target; raises ValueError if it is missing or no folder. Links are followed."""
    if not argument or argument.startswith("--"):
        raise ValueError("name the folder to scan: quillon scan FOLDER [--json]")
    path = os.path.abspath(argument)
    if not os.path.isdir(path):
        raise ValueError(f"{path} is no folder")
    return path
