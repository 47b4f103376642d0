"""Report sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from textwrap import indent

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import iso_utc, or_empty, pad_end, truthy
from quillon.operators.correlate import ranked

#: Fixed value: shown where a finding has no location.
NO_LOCATION = "repository"


def location_text(location: Column) -> Column:
    """path, or path:line where there is a line other than 0; a fixed word without location."""
    line = F.when(location["start_line"] != 0, F.concat(F.lit(":"), location["start_line"].cast("string")))
    return F.when(location.isNull(), F.lit(NO_LOCATION)).otherwise(F.concat(or_empty(location["path"]), or_empty(line)))


def finding_lines(severity: Column, title: Column, location: Column, scanner: Column, remediation: Column) -> Column:
    """The text block of one finding: head, place, source, the fix if there is one, and an empty line."""
    rule = F.when(truthy(scanner["rule_id"]), F.concat(F.lit(" / "), scanner["rule_id"]))
    fix = F.when(truthy(remediation), F.concat(F.lit("  fix: "), remediation, F.lit("\n")))
    return F.concat(
        F.lit("["), F.upper(severity), F.lit("] "), title, F.lit("\n  "), location_text(location),
        F.lit("\n  source: "), or_empty(scanner["name"]), or_empty(rule), F.lit("\n"), or_empty(fix),
    )


def text_report(groups: DataFrame) -> DataFrame:
    """One row per group in rank order: scan_id and the text block of its primary."""
    p = F.col("primary")
    return ranked(groups).select("scan_id", finding_lines(p["severity"], p["title"], p["location"], p["scanner"], p["remediation"]).alias("lines"))


def summary_line(groups: int, raw: int) -> str:
    return f"{groups} correlated finding(s) ({raw} raw)"


def _finding_json(finding: Column) -> Column:
    """A finding under its report names. Absent parts are left out; metadata is the object itself, not its text."""
    f = finding
    return F.struct(
        f["id"].alias("id"), f["title"].alias("title"), f["description"].alias("description"), f["category"].alias("category"),
        f["severity"].alias("severity"), f["confidence"].alias("confidence"),
        F.struct(f["scanner"]["name"].alias("name"), f["scanner"]["version"].alias("version"), f["scanner"]["rule_id"].alias("ruleId")).alias("scanner"),
        F.when(
            f["location"].isNotNull(),
            F.struct(*(f["location"][a].alias(b) for a, b in (("path", "path"), ("start_line", "startLine"), ("end_line", "endLine"), ("start_column", "startColumn"), ("end_column", "endColumn")))),
        ).alias("location"),
        f["identifiers"].alias("identifiers"), f["evidence"].alias("evidence"), f["remediation"].alias("remediation"),
        f["fingerprint"].alias("fingerprint"), F.try_parse_json(f["metadata"]).alias("metadata"),
    )


def json_findings(groups: DataFrame) -> DataFrame:
    """One row per group in rank order: scan_id and the group as JSON. Written as text this scales with the groups."""
    source = lambda s: F.struct(s["name"].alias("name"), s["version"].alias("version"), s["rule_id"].alias("ruleId"))
    body = F.struct("fingerprint", _finding_json(F.col("primary")).alias("primary"), F.transform("duplicates", _finding_json).alias("duplicates"), F.transform("sources", source).alias("sources"))
    return ranked(groups).select("scan_id", F.to_json(body).alias("json"))


def json_document(groups: DataFrame, target: str, scanners: list[str], raw: int) -> Iterator[str]:
    """The whole report of one interactive scan as one document, in parts; groups come one after another."""
    head = {"target": target, "scanners": scanners, "rawFindingCount": raw, "correlatedFindingCount": groups.count(), "findings": []}
    opened, closed = json.dumps(head, indent=2, ensure_ascii=False).rsplit("]", 1)
    yield opened
    between = "\n"
    for r in json_findings(groups).toLocalIterator():
        yield between + indent(json.dumps(json.loads(r.json), indent=2, ensure_ascii=False), "    ")
        between = ",\n"
    yield ("]" if between == "\n" else "\n  ]") + closed


def header_lines(scans: DataFrame) -> DataFrame:
    """scan_id, scanner, started (ISO-8601), path and the number of diagnostics of each scan header; empty where missing."""
    return scans.select(
        "scan_id", "scanner", or_empty(iso_utc(F.col("started_at"))).alias("started"), or_empty(F.col("target.path")).alias("path"), F.coalesce(F.size("diagnostics"), F.lit(0)).alias("diagnostics")
    )


def availability_lines(availability: DataFrame) -> DataFrame:
    """One line per scanner: state, name and version or reason."""
    state = F.when(F.col("available"), F.lit("OK")).otherwise(F.lit("MISSING"))
    detail = F.coalesce("version", "reason", F.lit(""))
    return availability.orderBy("scanner_seq").select(F.concat(pad_end(state, 8), F.lit(" "), pad_end(F.col("display_name"), 18), F.lit(" "), detail).alias("line"))
