"""The report flattener and the window-free summary over a stream.

Flattening is stateless, so it is the same plan as for tables. The primary of a group is kept in state by the same
partial aggregate as ``operators.correlate.summary``; ``ord`` has to be carried by the rows, as arrival order means nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.correlate import prepared
from quillon.operators.normalize import findings


def report_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Report files as they arrive in a folder, one row per file: scan_id, scanner_seq, raw."""
    read = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return read.select(F.col("_metadata.file_path").alias("scan_id"), F.lit(0).alias("scanner_seq"), F.col("value").alias("raw"))


def finding_stream(reports: DataFrame) -> DataFrame:
    """Findings of a stream of reports; malformed reports give none."""
    return findings(reports)


def primary_stream(stream: DataFrame) -> DataFrame:
    """The current primary of each group; write it in update or complete mode."""
    payload = F.struct(*[c for c in stream.columns if c != "scan_id"])
    best_first = F.struct(-F.col("weight"), -F.col("confidence"), F.col("position"))
    return prepared(stream).groupBy("scan_id", "group_fingerprint").agg(F.count("*").alias("members"), F.min_by(payload, best_first).alias("primary"))
