"""Group findings by fingerprint within a scan, exactly as an ordered fold would.

Order is the column ``ord``; findings that share it are told apart by ``id``. The fold keeps a primary for each group
and replaces it when a later finding is strictly higher in (severity weight, confidence). A displaced primary joins the
duplicates at the moment it is displaced. All of it is expressed with running windows over one hash partitioning.

No task holds a group of more than ``LARGE`` rows. Larger ones are parted by ranges of (group, position), windows run within
a part, and what a part has to know of the others is added: only its first and its last group can lie in other parts too,
so that is two rows a part. The result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.fingerprint import finding_fingerprint
from quillon.functions.text import or_empty
from quillon.schema import severity_weight
from quillon.session import staged

GROUP = ("scan_id", "group_fingerprint")
#: Rows of a group, or groups of a scan, that one task sorts at most.
LARGE = 1_000_000


def prepared(findings: DataFrame) -> DataFrame:
    """Add group_fingerprint, weight, position and source_key."""
    return findings.select(
        "*",
        finding_fingerprint().alias("group_fingerprint"),
        severity_weight(F.col("severity")).alias("weight"),
        F.struct("ord", "id").alias("position"),
        F.concat(or_empty(F.col("scanner.name")), F.lit(":"), or_empty(F.col("scanner.rule_id"))).alias("source_key"),
    )


def accepted(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into usable findings and diagnostics (scan_id, id, problem).

    A finding needs a title, a severity of the six names, a finite confidence and a scanner; NaN would sort above all
    numbers here.
    """
    problem = (
        F.when(F.col("title").isNull(), F.lit("no title"))
        .when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit("no confidence"))
        .when(~F.coalesce(F.col("severity").isin("critical", "high", "medium", "low", "info", "unknown"), F.lit(False)), F.lit("unknown severity"))
        .when(F.col("scanner").isNull(), F.lit("no scanner"))
    )
    marked = findings.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null").select("scan_id", "id", "problem")


def _large(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame | None:
    """The keys with more than ``LARGE`` rows, if there are any."""
    found = staged(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select(*keys))
    return None if found.isEmpty() else found


def _of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows with or without some keys."""
    same = F.lit(True)
    for k in keys.columns:
        same = same & rows[k].eqNullSafe(keys[k])
    return rows.join(keys, same, how)


def _parted(rows: DataFrame, keys: tuple[str, ...], *order: Column | str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``part``, their range of (keys, order), and those of the first and last group of each part."""
    placed = staged(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    ends = placed.groupBy("part").agg(F.min(F.struct(*keys)).alias("a"), F.max(F.struct(*keys)).alias("b"))
    edges = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("key")).select("part", "key.*")
    return placed, _beside(placed, edges, keys, "left_semi")


def _beside(rows: DataFrame, edges: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Join what is known of the groups at the ends of parts: two rows a part, so it can be broadcast."""
    renamed = edges.select(*(F.col(c).alias(f"e_{c}" if c in ("part", *keys) else c) for c in edges.columns))
    same = F.col("part") == F.col("e_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    return rows.join(F.broadcast(renamed), same, how).drop("e_part", *(f"e_{k}" for k in keys))


def members(findings: DataFrame) -> DataFrame:
    """One row per finding with its part in its group.

    Adds group_fingerprint, role ('primary' or 'duplicate'), push_position (the order of the duplicates), source_first
    (the finding brought a new source) and first_position of the group. One shuffle on (scan_id, group_fingerprint)
    serves all windows; the flat form can spill where a nested list could not. Empty input gives no rows.
    """
    rows = prepared(findings)
    large = _large(rows, GROUP)
    if large is None:
        return _told(rows, GROUP)
    small = _told(_of(rows, large, "left_anti"), GROUP)
    return small.unionByName(_members_of_large(_of(rows, large, "left_semi")).select(*small.columns))


def _told(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The windows of ``members`` over whole groups, or over parts of groups with what they know of the others."""
    level = F.struct("weight", "confidence")
    group = Window.partitionBy(*keys)
    forward = group.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    # the same as a frame over the following rows, which would be quadratic
    backward = group.orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    source = Window.partitionBy(*keys, "source_key").orderBy("position")
    best: Column = F.max(level).over(forward)
    behind: Column = F.min(F.when(F.col("is_record"), F.col("position"))).over(backward)
    first: Column = F.min("position").over(group)
    new: Column = F.row_number().over(source) == 1
    if "part" in keys:
        best, behind, first, new = F.greatest(best, "top_before"), F.coalesce(behind, "record_behind"), F.coalesce("group_first", first), new & F.col("seen").isNull()
    return (
        rows.withColumn("is_record", best.isNull() | (level > best))
        .withColumn("next_record", behind)
        .withColumn("first_position", first)
        .withColumn("source_first", new)
        .withColumn("role", F.when(F.col("is_record") & F.col("next_record").isNull(), F.lit("primary")).otherwise(F.lit("duplicate")))
        .withColumn("push_position", F.when(F.col("is_record"), F.col("next_record")).otherwise(F.col("position")))
        .drop("is_record", "next_record")
    )


def _members_of_large(rows: DataFrame) -> DataFrame:
    level = F.struct("weight", "confidence")
    placed, ends = _parted(rows, GROUP, "position")
    across = Window.partitionBy(*GROUP).orderBy("part")
    before, behind = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (across, Window.partitionBy(*GROUP).orderBy(F.desc("part"))))
    known = ends.groupBy("part", *GROUP).agg(F.max(level).alias("top"), F.min("position").alias("first"))
    known = known.select("part", *GROUP, F.max("top").over(before).alias("top_before"), F.min("first").over(Window.partitionBy(*GROUP)).alias("group_first"))
    records = _beside(ends, known, GROUP, "inner").where(F.col("top_before").isNull() | (level > F.col("top_before"))).groupBy("part", *GROUP).agg(F.min("position").alias("record"))
    records = _beside(known, records, GROUP, "left").select("part", *GROUP, "top_before", "group_first", F.min("record").over(behind).alias("record_behind"))
    # sources that an earlier part of the group has had; a group can have many, so this is a plain join
    first_part = F.min("part").over(Window.partitionBy(*GROUP, "source_key"))
    again = ends.select("part", *GROUP, "source_key").distinct().withColumn("first_part", first_part).where("first_part < part")
    again = again.select(*(F.col(c).alias(f"s_{c}") for c in ("part", *GROUP, "source_key")), F.lit(True).alias("seen"))
    same = F.lit(True)
    for c in ("part", *GROUP, "source_key"):
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return _told(_beside(placed, records, GROUP, "left").join(again, same, "left"), ("part", *GROUP))


def summary(findings: DataFrame) -> DataFrame:
    """Primary and counts of each group by one partial aggregate, without windows or nested lists.

    Columns: scan_id, group_fingerprint, members, sources, first_position and primary (the finding as a struct). Of
    equal findings the earliest is the primary.
    """
    payload = F.struct(*[c for c in findings.columns if c != "scan_id"])
    best_first = F.struct(-F.col("weight"), -F.col("confidence"), F.col("position"))
    return (
        prepared(findings)
        .groupBy(*GROUP)
        .agg(
            F.count("*").alias("members"),
            F.countDistinct("source_key").alias("sources"),
            F.min("position").alias("first_position"),
            F.min_by(payload, best_first).alias("primary"),
        )
    )


def sources(findings: DataFrame) -> DataFrame:
    """The distinct sources of each group: scan_id, group_fingerprint, source_pos (from 0), scanner of the first finding."""
    first = (
        prepared(findings)
        .groupBy(*GROUP, "source_key")
        .agg(F.min("position").alias("position"), F.min_by("scanner", "position").alias("scanner"))
    )
    order = Window.partitionBy(*GROUP).orderBy("position")
    return first.select(*GROUP, (F.row_number().over(order) - 1).alias("source_pos"), "scanner")


def correlated(findings: DataFrame) -> DataFrame:
    """Nested form: scan_id, fingerprint, primary, duplicates and sources, both in fold order.

    The lists of one group sit in one row; for groups too large for that, use ``members``.
    """
    payload = F.struct(*[c for c in findings.columns if c != "scan_id"])
    flat = members(findings)
    by_place = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    listed = flat.groupBy(*GROUP).agg(
        F.first(F.when(F.col("role") == "primary", payload), ignorenulls=True).alias("primary"),
        F.collect_list(F.when(F.col("role") == "duplicate", F.struct(F.col("push_position").alias("at"), payload.alias("row")))).alias("d"),
        F.collect_list(F.when(F.col("source_first"), F.struct(F.col("position").alias("at"), F.col("scanner").alias("row")))).alias("s"),
        F.first("first_position").alias("first_position"),
    )
    return listed.select(
        "scan_id",
        F.col("group_fingerprint").alias("fingerprint"),
        "primary",
        F.transform(F.array_sort("d", by_place), lambda x: x["row"]).alias("duplicates"),
        F.transform(F.array_sort("s", by_place), lambda x: x["row"]).alias("sources"),
        "first_position",
    )


def ranked(groups: DataFrame) -> DataFrame:
    """Order groups of a scan by the primary's severity and confidence, both descending, then by first appearance.

    A sort of Spark is not stable, so first appearance is a key of its own. Adds nothing; the order is the result.
    """
    return groups.orderBy(
        "scan_id", severity_weight(F.col("primary.severity")).desc(), F.col("primary.confidence").desc(), "first_position"
    )


def group_rank(groups: DataFrame) -> DataFrame:
    """Add group_rank (from 1), the place ``ranked`` gives each group within its scan. In scans of more than ``LARGE`` groups
    a rank is the place within a part plus the groups of the scan in the parts before."""
    order = (-severity_weight(F.col("primary.severity"))).alias("w"), (-F.col("primary.confidence")).alias("c")
    keyed = groups.select("*", F.struct(*order, F.col("first_position").alias("p")).alias("rank_key"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("rank_key")).cast("bigint")
    large = _large(groups, ("scan_id",))
    if large is None:
        return keyed.withColumn("group_rank", place("scan_id")).drop("rank_key")
    placed, ends = _parted(_of(keyed, large, "left_semi"), ("scan_id",), "rank_key")
    before = Window.partitionBy("scan_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = ends.groupBy("part", "scan_id").agg(F.count("*").alias("n")).select("part", "scan_id", F.sum("n").over(before).alias("offset"))
    ranked_ = _beside(placed, offset, ("scan_id",), "left").withColumn("group_rank", place("part", "scan_id") + F.coalesce("offset", F.lit(0)))
    small = _of(keyed, large, "left_anti").withColumn("group_rank", place("scan_id"))
    return small.unionByName(ranked_.select(*small.columns)).drop("rank_key")


def counts(findings: DataFrame) -> DataFrame:
    """Raw findings and groups of each scan. The groups are counted from a partial aggregate, so a hot group is no burden."""
    groups = prepared(findings).groupBy(*GROUP).agg(F.count("*").alias("n"))
    return groups.groupBy("scan_id").agg(F.sum("n").alias("raw_findings"), F.count("*").alias("groups"))
