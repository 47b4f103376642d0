"""Scanner reports to findings: flatten the nested report once and project each item by the rules of its class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import variant as V
from quillon.functions.text import truthy
from quillon.schema import IDENTIFIERS, LOCATION, ORD, SCANNER, normal_severity

#: The item classes of a report in their order, and the texts and confidences of each.
CLASSES = ("Vulnerabilities", "Secrets", "Misconfigurations")
CATEGORY = ("dependency", "secret", "misconfiguration")
DEFAULT_TITLE = ("Dependency vulnerability", "Potential secret detected", "Configuration issue")
CONFIDENCE = (0.95, 0.9, 0.9)
SCANNER_NAME = "trivy"
SECRET_REMEDIATION = "Revoke or rotate the exposed credential, then remove it from the repository and history where appropriate."
UPGRADE, TO, OR_LATER, UNNAMED_PACKAGE = "Upgrade ", " to ", " or later.", "the affected dependency"
IN_PACKAGE = " in "


def parsed(reports: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse the column ``raw``: documents with a VARIANT column ``doc``, and diagnostics (scan_id, problem).

    With ``strict`` a malformed report fails the query; otherwise it goes to the diagnostics.
    """
    if strict:
        return reports.withColumn("doc", F.parse_json("raw")), reports.where("false").select("scan_id", F.lit("").alias("problem"))
    read = reports.withColumn("doc", V.parse_json(F.col("raw")))
    broken = read.where("doc is null").select("scan_id", F.lit("report is no valid JSON").alias("problem"))
    return read.where("doc is not null"), broken


def flatten(documents: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """One row per report item: the other columns, ``ord``, ``target`` and the VARIANT ``item``.

    Results that are no object and items that are no object are skipped; anything that is no array has no entries. An
    item that is an array counts as an object without fields. Order is kept by ``ord``, wholly from positions. A column
    scanner_seq is used if there is one; else it is 0. Only items of ``classes`` (places in ``CLASSES``) are read.
    """
    seq = F.col("scanner_seq") if "scanner_seq" in documents.columns else F.lit(0)
    kept = [c for c in documents.columns if c not in ("doc", "raw", "scanner_seq")]
    results = documents.select(*kept, seq.cast("int").alias("seq"), F.posexplode(V.as_array(F.col("doc"), "$.Results")).alias("result_pos", "result"))

    def of(rank: int, target: Column) -> Column:
        entry = lambda item, pos: F.struct(F.lit(rank).alias("class_rank"), pos.alias("item_pos"), target.alias("target"), item.alias("item"))
        return F.coalesce(F.transform(V.as_array(F.col("result"), f"$.{CLASSES[rank]}"), entry), F.array().cast("array<struct<class_rank:int,item_pos:int,target:string,item:variant>>"))

    # each entry has its own target: a row behind the inline doesn't carry the whole result, which would be quadratic
    entries = V.let(V.as_text(F.col("result"), "$.Target"), lambda target: F.concat(*(of(rank, target) for rank in classes)))
    return (
        results.where(V.is_record(F.col("result")))
        .select(*kept, "seq", "result_pos", F.inline(entries))
        .where(V.is_record(F.col("item")))
        .select(*kept, F.struct(F.col("seq").alias("scanner_seq"), "result_pos", "class_rank", "item_pos").cast(ORD).alias("ord"), "target", "item")
    )


def _location(target: Column, line: Column) -> Column:
    whole = F.when((line != 0) & (line == F.floor(line)), line.cast("bigint"))
    none = F.lit(None).cast("bigint")
    return F.when(
        truthy(target),
        F.struct(target.alias("path"), whole.alias("start_line"), none.alias("end_line"), none.alias("start_column"), none.alias("end_column")),
    ).cast(LOCATION)


def normalize(items: DataFrame) -> DataFrame:
    """Findings in the finding schema from the rows of ``flatten``; needs scan_id.

    ``id`` is a hash of scan and place, so a rerun gives the same ids. Fractional lines are dropped.
    """
    rank = F.col("ord.class_rank")
    item = F.col("item")
    text = lambda name: V.as_text(item, f"$.{name}")
    by_class = lambda a, b, c: F.when(rank == 0, a).when(rank == 1, b).otherwise(c)
    none = F.lit(None).cast("string")

    rule = by_class(text("VulnerabilityID"), text("RuleID"), F.coalesce(text("ID"), text("AVDID")))
    package, fixed = text("PkgName"), text("FixedVersion")
    title = F.coalesce(text("Title"), rule, by_class(*map(F.lit, DEFAULT_TITLE)))
    title = F.when((rank == 0) & truthy(package), F.concat(title, F.lit(IN_PACKAGE), package)).otherwise(title)
    upgrade = F.when(truthy(fixed), F.concat(F.lit(UPGRADE), F.coalesce(package, F.lit(UNNAMED_PACKAGE)), F.lit(TO), fixed, F.lit(OR_LATER)))
    metadata = by_class(
        F.to_json(F.struct(package.alias("package"), text("InstalledVersion").alias("installedVersion"), fixed.alias("fixedVersion"), text("PrimaryURL").alias("primaryUrl"))),
        none,
        F.to_json(F.struct(text("Namespace").alias("namespace"), text("PrimaryURL").alias("primaryUrl"))),
    )
    identifiers = F.when(
        (rank == 0) & truthy(rule),
        F.struct(F.lit(None).alias("cwe"), F.array(rule).alias("cve"), F.lit(None).alias("osv"), F.lit(None).alias("ghsa")).cast(IDENTIFIERS),
    )
    line = F.when(rank == 1, V.as_number(item, "$.StartLine"))
    return items.select(
        "scan_id",
        "ord",
        F.sha2(F.concat_ws("/", F.col("scan_id"), F.to_json("ord")), 256).alias("id"),
        title.alias("title"),
        by_class(text("Description"), text("Category"), F.coalesce(text("Description"), text("Message"))).alias("description"),
        by_class(*map(F.lit, CATEGORY)).alias("category"),
        normal_severity(text("Severity")).alias("severity"),
        by_class(*map(F.lit, CONFIDENCE)).alias("confidence"),
        F.struct(F.lit(SCANNER_NAME).alias("name"), none.alias("version"), rule.alias("rule_id")).cast(SCANNER).alias("scanner"),
        _location(F.col("target"), line).alias("location"),
        identifiers.alias("identifiers"),
        F.when(rank == 1, text("Match")).alias("evidence"),
        by_class(upgrade, F.lit(SECRET_REMEDIATION), text("Resolution")).alias("remediation"),
        none.alias("fingerprint"),
        metadata.alias("metadata"),
    ).withColumn("severity", F.coalesce("severity", F.lit("unknown")))


def findings(reports: DataFrame, strict: bool = False, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Findings of raw reports: columns scan_id, raw and, if there are several scanners, scanner_seq."""
    return normalize(flatten(parsed(reports, strict)[0], classes))
