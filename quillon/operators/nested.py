"""Deeply nested reports to related flat tables that keep parent and place.

A report is parsed once into a VARIANT. Nested ``transform`` calls carry the keys and places of the ancestors down,
``flatten`` joins the lists of one report, and one ``inline`` for each target table emits its rows. There is no shuffle
beyond the one that drops reports delivered twice, and a row is never joined back to its parent.

Rules for every place: a lone value counts as a list of one; a text that holds a JSON object counts as that object;
null, missing or wrongly typed parts have no entries; an entry that is unusable keeps its place. Text that isn't one
valid JSON document gives no rows, as do empty and missing texts. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import variant as V
from quillon.operators.dedupe import once
from quillon.session import staged

IDENTIFIER_KINDS = ("cwe", "cve", "osv", "ghsa")

_VARIANTS = "array<variant>"


def _get(value: Column, name: str) -> Column:
    """The field of an object, or null; JSON's null counts as missing."""
    return V.let(F.try_variant_get(value, f"$.{name}", "variant"), lambda found: F.when(~F.is_variant_null(found), found))


def _object(value: Column) -> Column:
    """The value, or the object that its text holds."""

    def opened(v: Column) -> Column:
        text = F.when(V.kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
        held = F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))
        return F.coalesce(held, v)

    return V.let(value, opened)


def _list(value: Column) -> Column:
    """The entries of a list; a lone value is a list of one, nothing is an empty list."""
    return V.let(
        value,
        lambda v: F.coalesce(
            F.try_variant_get(v, "$", _VARIANTS), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)), F.array().cast(_VARIANTS)
        ),
    )


def _findings_of(result: Column) -> Column:
    """The findings of one scan result: a list, one finding, or an object that maps keys to findings."""
    return V.let(
        _object(_get(result, "findings")),
        lambda found: F.coalesce(
            F.try_variant_get(found, "$", _VARIANTS),
            F.when(V.as_text(found, "$.id").isNotNull(), F.array(found)),
            F.map_values(F.try_variant_get(found, "$", "map<string,variant>")),
            F.array().cast(_VARIANTS),
        ),
    )


def _unwrapped(value: Column) -> Column:
    """The scan result inside the wrappings ``payload`` and ``result``."""
    inside = lambda outer, name: V.let(outer, lambda o: F.coalesce(_object(_get(o, name)), o))
    return inside(inside(_object(value), "payload"), "result")


def documents(reports: DataFrame) -> DataFrame:
    """One row per valid report: report_id and ``found``, its findings as structs of pos, finding_id and finding.

    Reports delivered twice under one report_id count once. Entries that are no object are left out but keep their
    place; finding_id is null where ``id`` is no text.
    """
    parsed = once(reports.select("report_id", "raw"), "report_id").select("report_id", V.parse_json(F.col("raw")).alias("doc")).where("doc is not null")
    entries = F.flatten(F.transform(_list(F.col("doc")), lambda r: _findings_of(_unwrapped(r))))
    placed = F.transform(entries, lambda f, i: F.struct(i.alias("pos"), _object(f).alias("finding")))
    objects = F.filter(placed, lambda x: F.try_variant_get(x["finding"], "$", "map<string,variant>").isNotNull())
    found = F.transform(objects, lambda x: F.struct(x["pos"].alias("pos"), V.as_text(x["finding"], "$.id").alias("finding_id"), x["finding"].alias("finding")))
    return parsed.select("report_id", found.alias("found"))


def _places(finding: Column) -> Column:
    return F.transform(_list(_object(_get(finding, "location"))), lambda x, i: F.struct(i.alias("pos"), _object(x).alias("value")))


def _packages(finding: Column) -> Column:
    listed = _list(_object(_get(_object(_get(finding, "metadata")), "packages")))
    return F.transform(listed, lambda x, i: F.struct(i.alias("pos"), _object(x).alias("value")))


def _paths(package: Column) -> Column:
    return F.transform(_list(_object(_get(package, "paths"))), lambda x, i: F.struct(i.alias("pos"), _object(x).alias("value")))


def _identifiers(finding: Column, kind: str) -> Column:
    return _list(_get(_object(_get(finding, "identifiers")), kind))


def _table(docs: DataFrame, rows_of: object) -> DataFrame:
    """One inline over the rows that ``rows_of`` makes of each finding."""
    return docs.select("report_id", F.inline(F.flatten(F.transform("found", rows_of))))


def _whole(value: Column, name: str) -> Column:
    """The number of a field if it is a whole one."""
    return V.let(V.as_number(value, f"$.{name}"), lambda n: F.when(n == F.floor(n), n.cast("bigint")))


def findings(docs: DataFrame) -> DataFrame:
    """report_id, pos, finding_id and the plain fields of each finding; its scanner may be text that holds an object."""

    def row(x: Column) -> Column:
        f = x["finding"]
        text = lambda name: V.as_text(f, f"$.{name}").alias(name)
        scanner = lambda name: V.as_text(_object(_get(f, "scanner")), f"$.{name}")
        return F.struct(
            x["pos"].alias("pos"), x["finding_id"].alias("finding_id"), *map(text, ("title", "description", "category", "severity")), V.as_number(f, "$.confidence").alias("confidence"),
            scanner("name").alias("scanner_name"), scanner("version").alias("scanner_version"), scanner("ruleId").alias("rule_id"), *map(text, ("evidence", "remediation", "fingerprint")),
        )

    return docs.select("report_id", F.inline(F.transform("found", row)))


def _place_of(f: Column) -> list[Column]:
    return [f["pos"].alias("finding_pos"), f["finding_id"].alias("finding_id")]


def locations(docs: DataFrame) -> DataFrame:
    """report_id, finding_pos, finding_id, pos, path, start_line, end_line, start_column, end_column; null where there is
    none. Fractions of lines and columns count as none."""
    numbers = (("startLine", "start_line"), ("endLine", "end_line"), ("startColumn", "start_column"), ("endColumn", "end_column"))
    return _table(docs, lambda f: F.transform(
        _places(f["finding"]),
        lambda x: F.struct(*_place_of(f), x["pos"].alias("pos"), V.as_text(x["value"], "$.path").alias("path"), *(_whole(x["value"], a).alias(b) for a, b in numbers)),
    ))


def identifiers(docs: DataFrame) -> DataFrame:
    """report_id, finding_pos, finding_id, kind, pos, identifier; entries that are no text have a null identifier."""

    def of(f: Column, kind: str) -> Column:
        row = lambda x, i: F.struct(*_place_of(f), F.lit(kind).alias("kind"), i.alias("pos"), V.as_text(x).alias("identifier"))
        return F.transform(_identifiers(f["finding"], kind), row)

    return _table(docs, lambda f: F.concat(*(of(f, kind) for kind in IDENTIFIER_KINDS)))


def metadata(docs: DataFrame) -> DataFrame:
    """report_id, finding_pos, finding_id, key, text, number of each entry of the metadata but the packages; text and
    number are null where the value is neither."""

    def rows(f: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(_object(_get(f["finding"], "metadata")), "$", "map<string,variant>"))
        row = lambda e: F.struct(*_place_of(f), e["key"].alias("key"), V.as_text(e["value"]).alias("text"), V.as_number(e["value"]).alias("number"))
        listed = F.transform(F.filter(entries, lambda e: e["key"] != "packages"), row)
        return F.coalesce(listed, F.array().cast("array<struct<finding_pos:int,finding_id:string,key:string,text:string,number:double>>"))

    return _table(docs, rows)


def packages(docs: DataFrame) -> DataFrame:
    """report_id, finding_pos, finding_id, pos, name, installed_version, fixed_version of each package in the metadata."""
    return _table(docs, lambda f: F.transform(
        _packages(f["finding"]),
        lambda p: F.struct(*_place_of(f), p["pos"].alias("pos"), V.as_text(p["value"], "$.name").alias("name"), V.as_text(p["value"], "$.installedVersion").alias("installed_version"), V.as_text(p["value"], "$.fixedVersion").alias("fixed_version")),
    ))


def package_paths(docs: DataFrame) -> DataFrame:
    """report_id, finding_pos, finding_id, package_pos, pos, path, layer of each path of each package."""
    return _table(docs, lambda f: F.flatten(F.transform(
        _packages(f["finding"]),
        lambda p: F.transform(_paths(p["value"]), lambda x: F.struct(*_place_of(f), p["pos"].alias("package_pos"), x["pos"].alias("pos"), V.as_text(x["value"], "$.path").alias("path"), _whole(x["value"], "layer").alias("layer"))),
    )))


def tables(reports: DataFrame) -> dict[str, DataFrame]:
    """All flat tables by name. The reports are parsed once, into a table that all of them read."""
    docs = staged(documents(reports))
    return {make.__name__: make(docs) for make in (findings, locations, identifiers, metadata, packages, package_paths)}


def links(made: dict[str, DataFrame]) -> DataFrame:
    """child, rows, orphans: the rows of each table of ``tables`` below the findings, and those without their parent row."""
    out: DataFrame | None = None
    for child in ("locations", "identifiers", "metadata", "packages", "package_paths"):
        parent = ("packages", ["report_id", "finding_pos", "pos"]) if child == "package_paths" else ("findings", ["report_id", "pos"])
        parents = made[parent[0]].select(*(F.col(c).alias(n) for c, n in zip(parent[1], ("report_id", "finding_pos", "package_pos"), strict=False)), F.lit(1).alias("there"))
        keys = [c for c in parents.columns if c != "there"]
        counted = made[child].join(parents, keys, "left").agg(F.lit(child).alias("child"), F.count("*").alias("rows"), F.count_if(F.col("there").isNull()).alias("orphans"))
        out = counted if out is None else out.unionByName(counted)
    return out


def leaves(reports: DataFrame) -> DataFrame:
    """Every text leaf below the findings: report_id, finding_id, child, parent_pos, child_pos, leaf.

    Texts come verbatim; empty ones give no row.
    """
    leaf = lambda f, child, parent, at, text: F.struct(
        f["finding_id"].alias("finding_id"), F.lit(child).alias("child"), parent.cast("int").alias("parent_pos"), at.cast("int").alias("child_pos"), text.alias("leaf")
    )
    top = F.lit(0)

    def identifiers_of(f: Column, kind: str) -> Column:
        return F.transform(_identifiers(f["finding"], kind), lambda x, i: leaf(f, kind, top, i, V.as_text(x)))

    def rows_of(f: Column) -> Column:
        finding = f["finding"]
        return F.concat(
            F.transform(_places(finding), lambda x: leaf(f, "location", top, x["pos"], V.as_text(x["value"], "$.path"))),
            *(identifiers_of(f, kind) for kind in IDENTIFIER_KINDS),
            F.flatten(F.transform(
                _packages(finding),
                lambda p: F.concat(
                    F.array(leaf(f, "package", top, p["pos"], V.as_text(p["value"], "$.name"))),
                    F.transform(_paths(p["value"]), lambda x: leaf(f, "package_path", p["pos"], x["pos"], V.as_text(x["value"], "$.path"))),
                ),
            )),
        )

    return _table(documents(reports), rows_of).where("leaf <> ''")


def _sql_object(x: str) -> str:
    x = f"({x})"
    held = f"({x} ->> '$')"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({held}) AND ltrim({held}) LIKE '{{%' THEN CAST({held} AS JSON) WHEN json_type({x}) = 'NULL' THEN NULL ELSE {x} END"


def _sql_list(x: str) -> str:
    x = f"({x})"
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'NULL' THEN [] ELSE CASE WHEN {x} IS NULL THEN [] ELSE [{x}] END END"


def _sql_text(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN ({x}) ->> '$' END"


def _sql_base() -> str:
    """Findings, locations, identifiers, packages and package paths as common table expressions."""
    entries = "SELECT report_id, finding_pos, finding_id, {extra}pos, {value} AS value FROM (SELECT {source}.*, unnest(range(len(list))) AS pos, list FROM {source})"
    placed = lambda source, extra="": entries.format(source=source, extra=extra, value=_sql_object("list[pos + 1]"))
    kinds = " UNION ALL ".join(f"SELECT report_id, finding_pos, finding_id, '{k}' AS kind, {_sql_list(f'ids -> {k!r}')} AS list FROM (SELECT *, {_sql_object("f -> 'identifiers'")} AS ids FROM f)" for k in IDENTIFIER_KINDS)
    return f"""WITH r AS (SELECT DISTINCT ON (report_id) report_id, CAST(raw AS JSON) AS j FROM scan_reports WHERE json_valid(raw)),
r1 AS (SELECT report_id, unnest(range(len(l))) AS nth, l FROM (SELECT report_id, {_sql_list("j")} AS l FROM r)),
r2 AS (SELECT report_id, nth, {_sql_object("l[nth + 1]")} AS x FROM r1),
r3 AS (SELECT report_id, nth, coalesce({_sql_object("x -> 'payload'")}, x) AS x FROM r2),
r4 AS (SELECT report_id, nth, coalesce({_sql_object("x -> 'result'")}, x) AS x FROM r3),
r5 AS (SELECT report_id, nth, {_sql_object("x -> 'findings'")} AS fs FROM r4),
r6 AS (SELECT report_id, nth, CASE json_type(fs) WHEN 'ARRAY' THEN CAST(fs AS JSON[]) WHEN 'OBJECT' THEN CASE WHEN json_type(fs -> 'id') = 'VARCHAR' THEN [fs] ELSE list_transform(list_sort(json_keys(fs)), lambda k: json_extract(fs, '$."' || k || '"')) END ELSE [] END AS l FROM r5),
r7 AS (SELECT report_id, flatten(list(l ORDER BY nth)) AS l FROM r6 GROUP BY report_id),
r8 AS (SELECT report_id, unnest(range(len(l))) AS finding_pos, l FROM r7),
r9 AS (SELECT report_id, finding_pos, {_sql_object("l[finding_pos + 1]")} AS f FROM r8),
f AS (SELECT report_id, finding_pos, {_sql_text("f -> 'id'")} AS finding_id, f FROM r9 WHERE json_type(f) = 'OBJECT'),
l0 AS (SELECT report_id, finding_pos, finding_id, {_sql_list("x")} AS list FROM (SELECT *, {_sql_object("f -> 'location'")} AS x FROM f)),
l1 AS ({placed("l0")}),
i0 AS ({kinds}),
i1 AS (SELECT report_id, finding_pos, finding_id, kind, pos, {_sql_text("list[pos + 1]")} AS identifier FROM (SELECT i0.*, unnest(range(len(list))) AS pos FROM i0)),
p0 AS (SELECT report_id, finding_pos, finding_id, {_sql_list("x")} AS list FROM (SELECT *, {_sql_object("m -> 'packages'")} AS x FROM (SELECT *, {_sql_object("f -> 'metadata'")} AS m FROM f))),
p1 AS ({placed("p0")}),
q0 AS (SELECT report_id, finding_pos, finding_id, pos AS package_pos, {_sql_list("x")} AS list FROM (SELECT *, {_sql_object("value -> 'paths'")} AS x FROM p1)),
q1 AS ({placed("q0", "package_pos, ")})"""


def oracle_sql() -> dict[str, str]:
    """The leaves and the tables below the findings in SQL, for queries named p5_..."""
    base, path, name = _sql_base(), _sql_text("value -> 'path'"), _sql_text("value -> 'name'")
    number = "CAST({} AS INTEGER)".format
    rows = [
        f"SELECT report_id, finding_id, 'location' AS child, 0 AS parent_pos, {number('pos')} AS child_pos, {path} AS leaf FROM l1",
        f"SELECT report_id, finding_id, kind, 0, {number('pos')}, identifier FROM i1",
        f"SELECT report_id, finding_id, 'package', 0, {number('pos')}, {name} FROM p1",
        f"SELECT report_id, finding_id, 'package_path', {number('package_pos')}, {number('pos')}, {path} FROM q1",
    ]
    place = f"report_id, {number('finding_pos')} AS finding_pos, finding_id"
    double = lambda x: f"CASE WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(({x}) ->> '$' AS DOUBLE) END"
    whole = lambda x: f"CASE WHEN {double(x)} = floor({double(x)}) THEN CAST(CAST({double(x)} AS BIGINT) AS VARCHAR) END"
    field = lambda name, said: f"{_sql_text(name)} AS {said}"
    plain = ", ".join(field(f"f -> '{n}'", n) for n in ("title", "description", "category", "severity", "evidence", "remediation", "fingerprint"))
    counts = " UNION ALL ".join(f"SELECT '{name}' AS child, count(*) AS rows, CAST(0 AS BIGINT) AS orphans FROM {source}" for name, source in (("locations", "l1"), ("identifiers", "i1"), ("metadata", "m1"), ("packages", "p1"), ("package_paths", "q1")))
    base += f""",
m0 AS (SELECT report_id, finding_pos, finding_id, {_sql_object("f -> 'metadata'")} AS m FROM f),
m1 AS (SELECT *, json_extract(m, '$."' || key || '"') AS v FROM (SELECT *, unnest(json_keys(m)) AS key FROM m0 WHERE json_type(m) = 'OBJECT') WHERE key <> 'packages')"""
    return {
        "p5_found": f"{base} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE leaf <> ''",
        "p5_findings": f"""{base} SELECT report_id, {number('finding_pos')} AS pos, finding_id, {plain}, {double("f -> 'confidence'")} AS confidence,
  {field("s -> 'name'", "scanner_name")}, {field("s -> 'version'", "scanner_version")}, {field("s -> 'ruleId'", "rule_id")} FROM (SELECT *, {_sql_object("f -> 'scanner'")} AS s FROM f)""",
        "p5_locations": f"""{base} SELECT {place}, {number('pos')} AS pos, {path} AS path, {whole("value -> 'startLine'")} AS start_line, {whole("value -> 'endLine'")} AS end_line, {whole("value -> 'startColumn'")} AS start_column, {whole("value -> 'endColumn'")} AS end_column FROM l1""",
        "p5_identifiers": f"{base} SELECT {place}, kind, {number('pos')} AS pos, identifier FROM i1",
        "p5_metadata": f"{base} SELECT {place}, key, {field('v', 'text')}, {double('v')} AS number FROM m1",
        "p5_packages": f"""{base} SELECT {place}, {number('pos')} AS pos, {name} AS name, {_sql_text("value -> 'installedVersion'")} AS installed_version, {_sql_text("value -> 'fixedVersion'")} AS fixed_version FROM p1""",
        "p5_package_paths": f"""{base} SELECT {place}, {number('package_pos')} AS package_pos, {number('pos')} AS pos, {path} AS path, {whole("value -> 'layer'")} AS layer FROM q1""",
        "p5_links": f"{base} {counts}",
    }
