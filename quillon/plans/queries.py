"""The named queries over a data folder, and the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.fingerprint import computed_fingerprint, finding_fingerprint, identifier_set
from quillon.operators import correlate, nested, normalize, snapshots
from quillon.operators.dedupe import once
from quillon.plans import report
from quillon.schema import SEVERITY_WEIGHTS, normal_severity, severity_weight
from quillon.session import configure
from quillon.sources.reports import table

Query = Callable[[SparkSession, str], DataFrame]


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return once(table(spark, folder, "findings"), "id")


def _events_as_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings derived from events: few groups with many members each. ``ord`` follows event_id."""
    configure(spark)
    e = table(spark, folder, "events")
    user, number = F.col("user_id"), F.col("event_id")
    kind = F.create_map(*[F.lit(x) for pair in (("click", "sast"), ("error", "secret"), ("purchase", "dependency"), ("signup", "misconfiguration"), ("view", "license")) for x in pair])
    return e.select(
        F.lit("events").alias("scan_id"),
        F.struct(F.lit(0).alias("scanner_seq"), number.cast("int").alias("result_pos"), F.lit(0).alias("class_rank"), F.lit(0).alias("item_pos")).alias("ord"),
        number.cast("string").alias("id"),
        F.concat(F.lit("  Issue "), F.upper("event_type"), F.lit(" ")).alias("title"),
        kind[F.col("event_type")].alias("category"),
        F.element_at(F.array(*map(F.lit, SEVERITY_WEIGHTS)), (F.pmod(number, F.lit(6)) + 1).cast("int")).alias("severity"),
        (F.pmod(F.floor("value"), F.lit(101)) / 100).cast("double").alias("confidence"),
        F.struct(
            F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (F.pmod(number, F.lit(3)) + 1).cast("int")).alias("name"),
            F.lit(None).cast("string").alias("version"),
            F.when(F.pmod(user, F.lit(7)) != 0, F.concat(F.lit("RULE-"), F.pmod(user, F.lit(10)).cast("string"))).alias("rule_id"),
        ).alias("scanner"),
        F.when(
            F.pmod(user, F.lit(11)) != 0,
            F.struct(
                F.concat(F.lit("Src/Mod"), F.pmod(user, F.lit(5)).cast("string"), F.lit("/File.ts")).alias("path"),
                F.when(F.col("event_type") != "view", F.pmod(user, F.lit(13))).alias("start_line"),
            ),
        ).alias("location"),
        F.lit(None).cast("struct<cwe:array<string>,cve:array<string>,osv:array<string>,ghsa:array<string>>").alias("identifiers"),
        F.lit(None).cast("string").alias("remediation"),
        F.lit(None).cast("string").alias("fingerprint"),
    )


def severity_normalize(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    m = once(table(spark, folder, "group_members").select("member_id", "severity"), "member_id")
    s = F.coalesce(normal_severity(F.col("severity")), F.lit("unknown"))
    return m.select("member_id", s.alias("severity"), severity_weight(s).cast("bigint").alias("weight"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).select(
        "id", computed_fingerprint(F.col("category"), F.col("scanner.rule_id"), F.col("location"), F.col("identifiers"), F.col("title")).alias("fp")
    )


def fingerprint_override(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).select("id", finding_fingerprint().alias("fp"))


def identifier_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).select("id", identifier_set(F.col("identifiers")).alias("ids"))


def _primary(findings: DataFrame) -> DataFrame:
    g = correlate.summary(findings)
    return g.select("scan_id", F.col("group_fingerprint").alias("fp"), F.col("primary.id").alias("primary_id"), "members", "sources")


def _members(findings: DataFrame) -> DataFrame:
    place = Window.partitionBy("scan_id", "group_fingerprint", "role").orderBy("push_position")
    return correlate.members(findings).select(
        "scan_id", "id", F.col("group_fingerprint").alias("fp"), "role", (F.row_number().over(place) - 1).cast("bigint").alias("pos"), "source_first"
    )


def _sources(findings: DataFrame) -> DataFrame:
    return correlate.sources(findings).select(
        "scan_id", F.col("group_fingerprint").alias("fp"), F.col("source_pos").cast("bigint").alias("source_pos"), "scanner.name", F.col("scanner.rule_id").alias("rule_id")
    )


def _ranks(findings: DataFrame) -> DataFrame:
    return correlate.group_rank(correlate.summary(findings)).select("scan_id", F.col("group_fingerprint").alias("fp"), F.col("group_rank").cast("bigint").alias("group_rank"))


def _text(findings: DataFrame) -> DataFrame:
    p = F.col("primary")
    return correlate.summary(findings).select(
        "scan_id", p["id"].alias("id"), report.finding_lines(p["severity"], p["title"], p["location"], p["scanner"], p["remediation"]).alias("lines")
    )


def correlate_nested(spark: SparkSession, folder: str) -> DataFrame:
    g = correlate.correlated(_findings(spark, folder))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    names = F.array_join(F.transform("sources", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["rule_id"], F.lit("")))), ",")
    return g.select("scan_id", F.col("fingerprint").alias("fp"), F.col("primary.id").alias("primary_id"), ids("duplicates").alias("duplicates"), names.alias("sources"))


#: Items of a built report at most, and the key, group and identifier columns of each class of items.
BLOCK = 500
_CLASSES = (("part", "p_partkey", "p_brand", "Vulnerabilities"), ("events", "event_id", "event_type", "Secrets"), ("supplier", "s_suppkey", "s_nationkey", "Misconfigurations"))


def _reports(spark: SparkSession, folder: str, kinds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Scanner reports built from the base tables, one for each brand, event type or nation and block of keys, to be
    parsed back."""
    configure(spark)
    items = (
        F.struct(
            F.format_string("P-%09d", "p_partkey").alias("VulnerabilityID"), F.col("p_name").alias("PkgName"), F.upper("p_type").alias("Title"),
            F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_size").cast("string")).alias("FixedVersion"),
            F.element_at(F.array(F.lit("HIGH"), F.lit("Low"), F.lit("Negligible")), (F.col("p_size") % 3 + 1).cast("int")).alias("Severity"),
        ),
        F.struct(
            F.format_string("E-%09d", "event_id").alias("RuleID"), F.pmod("user_id", F.lit(5)).alias("StartLine"),
            F.col("props").alias("Match"), F.lit("CRITICAL").alias("Severity"),
        ),
        F.struct(
            F.format_string("S-%09d", "s_suppkey").alias("AVDID"), F.col("s_name").alias("Message"),
            F.when(F.col("s_acctbal") > 0, F.lit("medium")).alias("Severity"), F.lit("Do it.").alias("Resolution"),
        ),
    )
    built: DataFrame | None = None
    for kind in kinds:
        source, key, group, name = _CLASSES[kind]
        block = F.floor(F.col(key) / BLOCK).cast("bigint").alias("block")
        listed = table(spark, folder, source).groupBy(F.col(group).cast("string").alias("group"), block).agg(F.array_sort(F.collect_list(items[kind])).alias("items"))
        result = F.struct(F.concat(F.lit(f"{name}/"), F.col("group")).alias("Target"), F.col("items").alias(name))
        scan = F.concat(F.lit(f"{name}-"), "group", F.lit("-"), F.col("block").cast("string"))
        raw = listed.select(scan.alias("scan_id"), F.to_json(F.struct(F.array(result).alias("Results"))).alias("raw"))
        built = raw if built is None else built.unionByName(raw)
    return built


def _parsed(spark: SparkSession, folder: str, kind: int) -> DataFrame:
    f = normalize.findings(_reports(spark, folder, (kind,)), classes=(kind,))
    return f.select(
        "title", "description", "category", "severity", "confidence", F.col("scanner.rule_id").alias("rule_id"), F.col("location.path").alias("path"),
        F.col("location.start_line").cast("string").alias("line"), F.array_join("identifiers.cve", ",").alias("cve"), "evidence", "remediation",
    )


def report_flatten_order(spark: SparkSession, folder: str) -> DataFrame:
    f = normalize.findings(_reports(spark, folder))
    return f.select("scan_id", F.col("scanner.rule_id").alias("rule_id"), *(F.col(f"ord.{c}").cast("bigint").alias(c) for c in ("result_pos", "class_rank", "item_pos")))


#: Reports with something wrong, by the remainder of the key; # stands for the key.
_WRONG = (
    '{"Results":[null,3,"x",{"Target":"t#","Vulnerabilities":[7,null,{"VulnerabilityID":"V#","Severity":"HIGH"}]}]}',
    '{"Results":{"Target":"t#","Secrets":[{"RuleID":"R#"}]}}',
    '{"Results":[[],{"Target":"","Vulnerabilities":[[1]],"Secrets":{"RuleID":"R#"}}]}',
    '{"Results":[{"Target":5,"Vulnerabilities":[{"VulnerabilityID":#,"Title":{},"PkgName":["p"],"FixedVersion":2}]}]}',
    '{"Results":[{"Target":"t#","Secrets":[{"RuleID":"R#","StartLine":3.0},{"StartLine":"4"},{"StartLine":3.5,"Severity":" HIGH"},{"StartLine":0,"Severity":"High"}]}]}',
    '{"Results":[{"Target":"t#"',
    '{"Results":[{"Target":"t#","Secrets":[{"RuleID":"R#"}]}]} #',
    '[{"Results":[{"Secrets":[{}]}]}]',
    '{"Results":[{"Misconfigurations":[{"ID":null,"AVDID":"M#","Title":null,"Message":"m#","Description":7,"Resolution":""}],"Secrets":[{"RuleID":"a","RuleID":"R#"}]}]}',
)


def _malformed(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("scan_id"), (F.col("o_orderkey") % len(_WRONG)).alias("case"))
    return o.select("scan_id", F.replace(F.element_at(F.array(*map(F.lit, _WRONG)), (F.col("case") + 1).cast("int")), F.lit("#"), F.col("scan_id")).alias("raw"))


def report_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of reports with wrongly typed, missing and broken parts."""
    f = normalize.findings(_malformed(spark, folder))
    place = (F.col(f"ord.{c}").cast("bigint").alias(c) for c in ("result_pos", "class_rank", "item_pos"))
    return f.select("scan_id", *place, "title", "description", "severity", "remediation", F.col("scanner.rule_id").alias("rule_id"), F.col("location.path").alias("path"), F.col("location.start_line").cast("string").alias("line"))


def report_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """The reports that are no JSON document."""
    return normalize.parsed(_malformed(spark, folder))[1]


def report_two_scanners(spark: SparkSession, folder: str) -> DataFrame:
    """Two scanners over one target, the second sees every third part: findings in scanner order, correlated, with the
    scanners of the scan."""
    configure(spark)
    p = table(spark, folder, "part")
    item = F.struct(F.format_string("P-%09d", "p_partkey").alias("VulnerabilityID"), F.col("p_name").alias("PkgName"), F.lit("LOW").alias("Severity"))
    raw = F.to_json(F.struct(F.array(F.struct(F.lit("lock").alias("Target"), F.array(item).alias("Vulnerabilities"))).alias("Results"))).alias("raw")
    scan = F.col("p_partkey").cast("string").alias("scan_id")
    first, second = p.select(scan, F.lit(0).alias("scanner_seq"), raw), p.where("p_partkey % 3 = 0").select(scan, F.lit(1).alias("scanner_seq"), raw)
    reports = first.unionByName(second)
    names = F.array_join(F.transform(F.array_sort(F.collect_set("scanner_seq")), lambda i: F.concat(F.lit("scanner-"), i.cast("string"))), ",")
    listed = reports.groupBy("scan_id").agg(names.alias("scanners"))
    members = correlate.members(normalize.findings(reports)).select("scan_id", "id", F.col("ord.scanner_seq").cast("bigint").alias("scanner_seq"), "role", "source_first")
    return members.join(listed, "scan_id")


def report_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON sink, read back: what each written group says."""
    lines = report.json_findings(correlate.correlated(_findings(spark, folder)))
    at = lambda path: F.get_json_object("json", f"$.{path}")
    return lines.select(
        "scan_id", at("fingerprint").alias("fp"), at("primary.id").alias("primary_id"), at("primary.title").alias("title"), at("primary.scanner.ruleId").alias("rule_id"),
        at("primary.location.startLine").alias("line"), F.json_array_length(at("duplicates")).cast("bigint").alias("duplicates"), at("duplicates[0].id").alias("first_duplicate"),
        F.json_array_length(at("sources")).cast("bigint").alias("sources"), at("sources[0].name").alias("first_source"), F.contains("json", F.lit(":null")).alias("writes_nulls"),
    )


def report_text_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The text sink with the place of each block."""
    p = F.col("primary")
    ranks = correlate.group_rank(correlate.summary(_findings(spark, folder)))
    return ranks.select("scan_id", F.col("group_rank").cast("bigint").alias("place"), report.finding_lines(p["severity"], p["title"], p["location"], p["scanner"], p["remediation"]).alias("lines"))


def availability_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Availability lines, with suppliers as scanners."""
    configure(spark)
    s = table(spark, folder, "supplier")
    rows = s.select(
        F.col("s_suppkey").cast("int").alias("scanner_seq"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" of "), "s_name")).otherwise(F.col("s_name")).alias("display_name"),
        (F.col("s_acctbal") > 0).alias("available"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("1.0")).alias("version"), F.when(F.col("s_suppkey") % 3 == 1, F.lit("gone")).alias("reason"),
    )
    return report.availability_lines(rows)


def scan_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Scan headers as they are written, with times in ISO-8601."""
    configure(spark)
    return report.header_lines(once(table(spark, folder, "scans").where("feed = 'batch'").select("scan_id", "scanner", "started_at", "target", "diagnostics"), "scan_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return snapshots.changes(table(spark, folder, "scans"), table(spark, folder, "snapshot_rows"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return nested.leaves(table(spark, folder, "scan_reports"))


def _p5(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        configure(spark)
        made = getattr(nested, name)(nested.documents(table(spark, folder, "scan_reports")))
        return made.select(*(F.col(c).cast("string").alias(c) if kind == "bigint" and c != "report_id" else c for c, kind in made.dtypes))  # numbers that may be null

    return query


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """All flat tables from one parse: how many rows each has, and how many of them lack their parent."""
    configure(spark)
    return nested.links(nested.tables(table(spark, folder, "scan_reports")))


def queries() -> dict[str, Query]:
    on = lambda make, source: lambda spark, folder: make(source(spark, folder))
    return {
        "severity_normalize": severity_normalize,
        "finding_fingerprint": fingerprints,
        "fingerprint_override": fingerprint_override,
        "identifier_set": identifier_sets,
        "correlate_primary": on(_primary, _findings),
        "correlate_members": on(_members, _findings),
        "correlate_sources": on(_sources, _findings),
        "correlate_nested": correlate_nested,
        "correlate_counts": on(correlate.counts, _findings),
        "rank_groups": on(_ranks, _findings),
        "report_text_lines": on(_text, _findings),
        "events_primary": on(_primary, _events_as_findings),
        "events_members": on(_members, _events_as_findings),
        "events_sources": on(_sources, _events_as_findings),
        "events_rank": on(_ranks, _events_as_findings),
        "events_counts": on(correlate.counts, _events_as_findings),
        "report_vulnerabilities": lambda s, d: _parsed(s, d, 0),
        "report_secrets": lambda s, d: _parsed(s, d, 1),
        "report_misconfigurations": lambda s, d: _parsed(s, d, 2),
        "report_flatten_order": report_flatten_order,
        "report_malformed": report_malformed,
        "report_diagnostics": report_diagnostics,
        "report_two_scanners": report_two_scanners,
        "report_json_lines": report_json_lines,
        "report_text_ranked": report_text_ranked,
        "availability_lines": availability_lines,
        "scan_headers": scan_headers,
        "p2_found": p2_found,
        "p5_found": p5_found,
        "p5_findings": _p5("findings"),
        "p5_locations": _p5("locations"),
        "p5_identifiers": _p5("identifiers"),
        "p5_metadata": _p5("metadata"),
        "p5_packages": _p5("packages"),
        "p5_package_paths": _p5("package_paths"),
        "p5_links": p5_links,
    }


# SQL ----------------------------------------------------------------------------------------------------------------

_BLANK_CHARACTERS = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))

_FINDINGS = "f0 AS (SELECT DISTINCT ON (id) * FROM findings)"
_EVENTS = """f0 AS (SELECT 'events' AS scan_id, {'scanner_seq': 0, 'result_pos': CAST(event_id AS INTEGER), 'class_rank': 0, 'item_pos': 0} AS ord,
  CAST(event_id AS VARCHAR) AS id, '  Issue ' || upper(event_type) || ' ' AS title,
  CASE event_type WHEN 'click' THEN 'sast' WHEN 'error' THEN 'secret' WHEN 'purchase' THEN 'dependency' WHEN 'signup' THEN 'misconfiguration' WHEN 'view' THEN 'license' END AS category,
  ['critical','high','medium','low','info','unknown'][CAST(event_id % 6 AS INTEGER) + 1] AS severity,
  CAST((CAST(floor(value) AS BIGINT) % 101 + 101) % 101 AS DOUBLE) / 100 AS confidence,
  {'name': ['alpha','beta','gamma'][CAST(event_id % 3 AS INTEGER) + 1], 'version': CAST(NULL AS VARCHAR), 'rule_id': CASE WHEN user_id % 7 <> 0 THEN 'RULE-' || CAST(user_id % 10 AS VARCHAR) END} AS scanner,
  CASE WHEN user_id % 11 <> 0 THEN {'path': 'Src/Mod' || CAST(user_id % 5 AS VARCHAR) || '/File.ts', 'start_line': CASE WHEN event_type <> 'view' THEN user_id % 13 END} END AS location,
  CAST(NULL AS STRUCT(cwe VARCHAR[], cve VARCHAR[], osv VARCHAR[], ghsa VARCHAR[])) AS identifiers, CAST(NULL AS VARCHAR) AS remediation, CAST(NULL AS VARCHAR) AS fingerprint FROM events)"""
_IDS = f"""array_to_string(list_sort(list_transform(list_concat(list_concat(coalesce(identifiers.cwe, []), coalesce(identifiers.cve, [])), list_concat(coalesce(identifiers.osv, []), coalesce(identifiers.ghsa, []))),
  lambda x: lower(trim(coalesce(x, ''), '{_BLANK_CHARACTERS}')))), ',')"""
_COMPUTED = f"""sha256(coalesce(category, '') || '|' || coalesce(scanner.rule_id, '') || '|' || coalesce(lower(location.path), '') || '|' || coalesce(CAST(location.start_line AS VARCHAR), '') || '|' || coalesce({_IDS}, '') || '|' || coalesce(lower(trim(title, '{_BLANK_CHARACTERS}')), ''))"""
_WEIGHT = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_PREPARED = f"""f AS (SELECT *, CASE WHEN coalesce(fingerprint, '') <> '' THEN fingerprint ELSE {_COMPUTED} END AS fp, {_WEIGHT} AS weight,
  row_number() OVER (PARTITION BY scan_id ORDER BY ord, id) AS p, scanner.name || ':' || coalesce(scanner.rule_id, '') AS source_key FROM f0),
g AS (SELECT *, row_number() OVER (PARTITION BY scan_id, fp ORDER BY weight DESC, confidence DESC, p) AS best, min(p) OVER (PARTITION BY scan_id, fp) AS first_p FROM f)"""


def _with(base: str, body: str) -> str:
    return f"WITH {base}, {_PREPARED} {body}"


_SQL_PRIMARY = "SELECT scan_id, fp, max(CASE WHEN best = 1 THEN id END) AS primary_id, count(*) AS members, count(DISTINCT source_key) AS sources FROM g GROUP BY scan_id, fp"
_SQL_MEMBERS = """, r AS (SELECT *, max(struct_pack(w := weight, c := confidence)) OVER (PARTITION BY scan_id, fp ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g),
m AS (SELECT *, b IS NULL OR struct_pack(w := weight, c := confidence) > b AS rec FROM r),
n AS (SELECT *, min(CASE WHEN rec THEN p END) OVER (PARTITION BY scan_id, fp ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nr,
  row_number() OVER (PARTITION BY scan_id, fp, source_key ORDER BY p) = 1 AS source_first FROM m),
o AS (SELECT *, CASE WHEN best = 1 THEN 'primary' ELSE 'duplicate' END AS role, CASE WHEN rec THEN nr ELSE p END AS push FROM n)
SELECT scan_id, id, fp, role, row_number() OVER (PARTITION BY scan_id, fp, role ORDER BY push) - 1 AS pos, source_first FROM o"""
_SQL_SOURCES = """, s AS (SELECT scan_id, fp, source_key, min(p) AS p, arg_min(scanner, p) AS sc FROM g GROUP BY ALL)
SELECT scan_id, fp, row_number() OVER (PARTITION BY scan_id, fp ORDER BY p) - 1 AS source_pos, sc.name AS name, sc.rule_id AS rule_id FROM s"""
_SQL_RANK = "SELECT scan_id, fp, row_number() OVER (PARTITION BY scan_id ORDER BY weight DESC, confidence DESC, first_p) AS group_rank FROM g WHERE best = 1"
_SQL_COUNTS = "SELECT scan_id, count(*) AS raw_findings, count(DISTINCT fp) AS groups FROM g GROUP BY scan_id"
_SQL_NESTED = (
    _SQL_MEMBERS.replace("SELECT scan_id, id, fp, role, row_number()", ", q AS (SELECT scan_id, id, fp, role, p, source_key, row_number()").replace("source_first FROM o", "source_first FROM o)")
    + """ SELECT scan_id, fp, max(CASE WHEN role = 'primary' THEN id END) AS primary_id, coalesce(string_agg(id, ',' ORDER BY pos) FILTER (role = 'duplicate'), '') AS duplicates,
  string_agg(source_key, ',' ORDER BY p) FILTER (source_first) AS sources FROM q GROUP BY scan_id, fp"""
)

_SQL_JSON = (
    _SQL_NESTED.replace("SELECT scan_id, fp, max(CASE", ", z AS (SELECT scan_id, fp, count(*) - 1 AS duplicates, max(CASE WHEN role = 'duplicate' AND pos = 0 THEN id END) AS first_duplicate, count(DISTINCT source_key) AS sources, arg_min(source_key, p) AS first_key, max(CASE")
    .replace("coalesce(string_agg(id, ',' ORDER BY pos) FILTER (role = 'duplicate'), '') AS duplicates,", "")
    .replace("END) AS primary_id, ", "END) AS primary_id")
    .replace("string_agg(source_key, ',' ORDER BY p) FILTER (source_first) AS sources", "")
    .replace("FROM q GROUP BY scan_id, fp", "FROM q GROUP BY scan_id, fp)")
    + """ SELECT z.scan_id, z.fp, primary_id, title, scanner.rule_id AS rule_id, CAST(location.start_line AS VARCHAR) AS line, duplicates, first_duplicate, sources, split_part(first_key, ':', 1) AS first_source, false AS writes_nulls
  FROM z JOIN f0 ON f0.id = z.primary_id"""
)
_SQL_MALFORMED = f"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % {len(_WRONG)} AS c FROM orders),
e(c, result_pos, class_rank, item_pos, title, description, severity, remediation, rule_id, path, line) AS (VALUES
  (0, 3, 0, 2, 'V#', NULL, 'high', NULL, 'V#', 't#', NULL),
  (2, 1, 0, 0, 'Dependency vulnerability', NULL, 'unknown', NULL, NULL, NULL, NULL),
  (3, 0, 0, 0, 'Dependency vulnerability', NULL, 'unknown', NULL, NULL, NULL, NULL),
  (4, 0, 1, 0, 'R#', NULL, 'unknown', '!', 'R#', 't#', 3), (4, 0, 1, 1, 'Potential secret detected', NULL, 'unknown', '!', NULL, 't#', NULL),
  (4, 0, 1, 2, 'Potential secret detected', NULL, 'unknown', '!', NULL, 't#', NULL), (4, 0, 1, 3, 'Potential secret detected', NULL, 'high', '!', NULL, 't#', NULL),
  (8, 0, 1, 0, 'R#', NULL, 'unknown', '!', 'R#', NULL, NULL), (8, 0, 2, 0, 'M#', 'm#', 'unknown', '', 'M#', NULL, NULL))
SELECT k AS scan_id, CAST(result_pos AS BIGINT) AS result_pos, CAST(class_rank AS BIGINT) AS class_rank, CAST(item_pos AS BIGINT) AS item_pos, replace(title, '#', k) AS title, replace(CAST(description AS VARCHAR), '#', k) AS description,
  severity, CASE remediation WHEN '!' THEN '{normalize.SECRET_REMEDIATION}' ELSE remediation END AS remediation, replace(rule_id, '#', k) AS rule_id, replace(path, '#', k) AS path, CAST(line AS VARCHAR) AS line FROM o JOIN e USING (c)"""

_REPO = r"""regexp_replace(regexp_replace(regexp_replace(trim(lower(target.repository_url), e' \t\n\r'), '^[a-z+]+://', ''), '^[^@/]*@', ''), '(\.git)?/*$', '')"""
_SQL_P2 = f"""WITH h0 AS (SELECT DISTINCT ON (scan_id) scan_id, completed_at, {_REPO} AS repo0, trim(target.branch) AS branch, regexp_replace(lower(target.commit_sha), '[^0-9a-f]', '', 'g') AS sha
  FROM scans WHERE feed = 'full' AND completed_at IS NOT NULL ORDER BY scan_id, completed_at),
h AS (SELECT *, regexp_replace(repo0, '^([^/:]+):', '\\1/') AS repo FROM h0 WHERE repo0 IS NOT NULL),
c AS (SELECT a.*, coalesce((SELECT max(b.sha) FROM h b WHERE b.repo = a.repo AND b.branch IS NOT DISTINCT FROM a.branch AND length(b.sha) > length(a.sha) AND length(a.sha) >= 7 AND starts_with(b.sha, a.sha)), a.sha) AS sha2 FROM h a),
l AS (SELECT * FROM c QUALIFY sha2 IS NULL OR sha2 = '' OR row_number() OVER (PARTITION BY repo, branch, sha2 ORDER BY completed_at DESC, scan_id DESC) = 1),
s AS (SELECT scan_id, lag(scan_id) OVER (PARTITION BY repo, branch ORDER BY completed_at, scan_id) AS before FROM l),
r AS (SELECT DISTINCT ON (scan_id, fp) scan_id, lower(trim(fingerprint)) AS fp, title, severity, round(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 2) AS conf, location.path AS path, location.start_line AS line, remediation
  FROM snapshot_rows WHERE trim(fingerprint) <> ''),
a AS (SELECT s.scan_id AS sid, r.* EXCLUDE (scan_id) FROM s JOIN r ON r.scan_id = s.scan_id WHERE s.before IS NOT NULL),
b AS (SELECT s.scan_id AS sid, r.* EXCLUDE (scan_id) FROM s JOIN r ON r.scan_id = s.before)
SELECT coalesce(a.sid, b.sid) AS scan_id, coalesce(a.fp, b.fp) AS fingerprint, CASE WHEN b.fp IS NULL THEN 'added' WHEN a.fp IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM a FULL OUTER JOIN b ON a.sid = b.sid AND a.fp = b.fp
WHERE a.fp IS NULL OR b.fp IS NULL OR (a.title, a.severity, a.conf, a.path, a.line, a.remediation) IS DISTINCT FROM (b.title, b.severity, b.conf, b.path, b.line, b.remediation)"""


def oracle_sql() -> dict[str, str]:
    lines = """'[' || upper(severity) || '] ' || title || e'\\n  ' || CASE WHEN location IS NULL THEN 'repository' ELSE coalesce(location.path, '') || CASE WHEN location.start_line <> 0 THEN ':' || CAST(location.start_line AS VARCHAR) ELSE '' END END
  || e'\\n  source: ' || coalesce(scanner.name, '') || CASE WHEN coalesce(scanner.rule_id, '') <> '' THEN ' / ' || scanner.rule_id ELSE '' END || e'\\n' || CASE WHEN coalesce(remediation, '') <> '' THEN '  fix: ' || remediation || e'\\n' ELSE '' END"""
    none = "CAST(NULL AS VARCHAR)"
    return {
        "severity_normalize": f"WITH m AS (SELECT DISTINCT member_id, CASE WHEN lower(severity) IN ('critical','high','medium','low','info') THEN lower(severity) ELSE 'unknown' END AS severity FROM group_members) SELECT member_id, severity, CAST({_WEIGHT} AS BIGINT) AS weight FROM m",
        "finding_fingerprint": f"WITH {_FINDINGS} SELECT id, {_COMPUTED} AS fp FROM f0",
        "fingerprint_override": f"WITH {_FINDINGS} SELECT id, CASE WHEN coalesce(fingerprint, '') <> '' THEN fingerprint ELSE {_COMPUTED} END AS fp FROM f0",
        "identifier_set": f"WITH {_FINDINGS} SELECT id, coalesce({_IDS}, '') AS ids FROM f0",
        "correlate_primary": _with(_FINDINGS, _SQL_PRIMARY),
        "correlate_members": _with(_FINDINGS, _SQL_MEMBERS),
        "correlate_sources": _with(_FINDINGS, _SQL_SOURCES),
        "correlate_nested": _with(_FINDINGS, _SQL_NESTED),
        "correlate_counts": _with(_FINDINGS, _SQL_COUNTS),
        "rank_groups": _with(_FINDINGS, _SQL_RANK),
        "report_text_lines": _with(_FINDINGS, f"SELECT scan_id, id, {lines} AS lines FROM g WHERE best = 1"),
        "events_primary": _with(_EVENTS, _SQL_PRIMARY),
        "events_members": _with(_EVENTS, _SQL_MEMBERS),
        "events_sources": _with(_EVENTS, _SQL_SOURCES),
        "events_rank": _with(_EVENTS, _SQL_RANK),
        "events_counts": _with(_EVENTS, _SQL_COUNTS),
        "report_vulnerabilities": f"""SELECT upper(p_type) || ' in ' || p_name AS title, {none} AS description, 'dependency' AS category,
  CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity, CAST(0.95 AS DOUBLE) AS confidence, printf('P-%09d', p_partkey) AS rule_id, 'Vulnerabilities/' || p_brand AS path,
  CAST(NULL AS VARCHAR) AS line, printf('P-%09d', p_partkey) AS cve, {none} AS evidence, CASE WHEN p_size % 3 <> 0 THEN 'Upgrade ' || p_name || ' to ' || CAST(p_size AS VARCHAR) || ' or later.' END AS remediation FROM part""",
        "report_secrets": f"""SELECT printf('E-%09d', event_id) AS title, {none} AS description, 'secret' AS category, 'critical' AS severity, CAST(0.9 AS DOUBLE) AS confidence, printf('E-%09d', event_id) AS rule_id,
  'Secrets/' || event_type AS path, CAST(nullif(user_id % 5, 0) AS VARCHAR) AS line, {none} AS cve, props AS evidence, '{normalize.SECRET_REMEDIATION}' AS remediation FROM events""",
        "report_misconfigurations": f"""SELECT printf('S-%09d', s_suppkey) AS title, s_name AS description, 'misconfiguration' AS category, CASE WHEN s_acctbal > 0 THEN 'medium' ELSE 'unknown' END AS severity,
  CAST(0.9 AS DOUBLE) AS confidence, printf('S-%09d', s_suppkey) AS rule_id, 'Misconfigurations/' || CAST(s_nationkey AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS line, {none} AS cve, {none} AS evidence, 'Do it.' AS remediation FROM supplier""",
        "report_flatten_order": " UNION ALL ".join(
            f"SELECT '{name}-' || CAST({group} AS VARCHAR) || '-' || CAST({key} // {BLOCK} AS VARCHAR) AS scan_id, printf('{name_}-%09d', {key}) AS rule_id, CAST(0 AS BIGINT) AS result_pos, CAST({rank} AS BIGINT) AS class_rank, row_number() OVER (PARTITION BY {group}, {key} // {BLOCK} ORDER BY {key}) - 1 AS item_pos FROM {source}"
            for rank, ((source, key, group, name), name_) in enumerate(zip(_CLASSES, "PES", strict=True))
        ),
        "report_malformed": _SQL_MALFORMED,
        "report_diagnostics": f"SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, 'report is no valid JSON' AS problem FROM orders WHERE o_orderkey % {len(_WRONG)} IN (5, 6)",
        "report_two_scanners": """WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS scan_id, s AS scanner_seq, p_partkey % 3 = 0 AS two FROM part, (VALUES (0), (1)) v(s) WHERE s = 0 OR p_partkey % 3 = 0)
SELECT scan_id, sha256(scan_id || '/' || '{"scanner_seq":' || scanner_seq || ',"result_pos":0,"class_rank":0,"item_pos":0}') AS id, CAST(scanner_seq AS BIGINT) AS scanner_seq,
  CASE scanner_seq WHEN 0 THEN 'primary' ELSE 'duplicate' END AS role, scanner_seq = 0 AS source_first, CASE WHEN two THEN 'scanner-0,scanner-1' ELSE 'scanner-0' END AS scanners FROM x""",
        "report_json_lines": _with(_FINDINGS, _SQL_JSON),
        "report_text_ranked": _with(_FINDINGS, f"SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY weight DESC, confidence DESC, first_p) AS place, {lines} AS lines FROM g WHERE best = 1"),
        "availability_lines": """SELECT CASE WHEN s_acctbal > 0 THEN 'OK      ' ELSE 'MISSING ' END || ' ' || n || repeat(' ', greatest(0, 18 - length(n))) || ' ' || CASE s_suppkey % 3 WHEN 0 THEN '1.0' WHEN 1 THEN 'gone' ELSE '' END AS line
  FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' of ' || s_name ELSE s_name END AS n FROM supplier)""",
        "scan_headers": """SELECT DISTINCT scan_id, scanner, coalesce(strftime(started_at, '%Y-%m-%dT%H:%M:%S') || printf('.%03dZ', CAST(extract('milliseconds' FROM started_at) AS BIGINT) % 1000), '') AS started, coalesce(target.path, '') AS path, CAST(coalesce(len(diagnostics), 0) AS INTEGER) AS diagnostics FROM (SELECT DISTINCT ON (scan_id) * FROM scans WHERE feed = 'batch')""",
        "p2_found": _SQL_P2,
        **nested.oracle_sql(),
    }
