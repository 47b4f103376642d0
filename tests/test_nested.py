"""The nested operator against a plain walk over parsed JSON."""

import json

from quillon.operators import nested
from quillon.sources.reports import table


def walk(raw):
    """All leaves of one report, by recursion over Python objects."""

    def obj(v):
        if isinstance(v, str):
            try:
                held = json.loads(v)
            except ValueError:
                return v
            return held if isinstance(held, dict) else v
        return v

    def many(v):
        return v if isinstance(v, list) else [] if v is None else [v]

    def get(v, k):
        return v.get(k) if isinstance(v, dict) else None

    try:
        root = json.loads(raw)
    except (ValueError, TypeError):
        return
    for result in many(root):
        for wrap in ("payload", "result"):
            result = obj(result)
            inner = obj(get(result, wrap))
            result = result if inner is None else inner
        found = obj(get(result, "findings"))
        if isinstance(found, dict):
            found = [found] if isinstance(found.get("id"), str) else list(found.values())
        for f in found if isinstance(found, list) else []:
            f = obj(f)
            if not isinstance(f, dict):
                continue
            fid = f.get("id") if isinstance(f.get("id"), str) else None
            out = [("location", 0, i, get(obj(x), "path")) for i, x in enumerate(many(obj(f.get("location"))))]
            for kind in nested.IDENTIFIER_KINDS:
                out += [(kind, 0, i, x) for i, x in enumerate(many(get(obj(f.get("identifiers")), kind)))]
            for i, p in enumerate(many(obj(get(obj(f.get("metadata")), "packages")))):
                p = obj(p)
                out.append(("package", 0, i, get(p, "name")))
                out += [("package_path", i, j, get(obj(x), "path")) for j, x in enumerate(many(obj(get(p, "paths"))))]
            yield from ((fid, *row) for row in out if isinstance(row[3], str) and row[3])


def test_leaves_of_the_test_data(spark):
    reports = table(spark, "/root/testdata/sf0.01", "scan_reports")
    seen = {r.report_id: r.raw for r in reports.collect()}
    want = sorted(map(repr, ((i, *row) for i, raw in seen.items() for row in walk(raw))))
    got = sorted(repr(tuple(r)) for r in nested.leaves(reports).collect())
    assert len(want) > 1000 and got == want


CASES = {
    1: None,
    2: "",
    3: "{",
    4: '{"findings":[{"id":"a","location":{"path":"p"}}]} x',
    5: "5",
    6: "[]",
    7: '{"findings":[{"id":"a","location":[null,7,{"path":"p"},{"path":3}],"identifiers":{"cve":"C","cwe":[1,"W",null,{}]}}]}',
    8: '[{"result":{"findings":{"x":{"id":"b","metadata":"{\\"packages\\":{\\"name\\":\\"n\\",\\"paths\\":[null,{\\"path\\":\\"q\\"}]}}"}}}}]',
    9: '{"payload":{"result":{"findings":{"id":"c","location":"{\\"path\\":\\"z\\"}"}}}}',
    10: '{"findings":[{"id":"d","location":{"path":"one","path":"two"}},"skip",null,{"identifiers":{"osv":["O"]}}]}',
    11: '{"findings":[{"id":"e","location":{"path":"' + "x" * 200_000 + '"}}]}',
    12: '{"findings":[{"id":"f","location":{"path":"ü\\u00e9\\n \\"q\\""}}]}',
}


def test_cases(spark):
    rows = [(i, raw, "extra") for i, raw in CASES.items()] * 2
    reports = spark.createDataFrame(rows, "report_id long, raw string, leaf string")
    want = sorted(map(repr, ((i, *row) for i, raw in CASES.items() for row in walk(raw))))
    assert sorted(repr(tuple(r)) for r in nested.leaves(reports).collect()) == want
    assert {r.report_id for r in nested.leaves(reports).collect()} == {7, 8, 9, 10, 11, 12}


def test_tables_link_to_parents(spark):
    docs = nested.documents(spark.createDataFrame([(8, CASES[8]), (7, CASES[7])], "report_id long, raw string"))
    assert [(r.report_id, r.finding_id) for r in nested.findings(docs).orderBy("report_id").collect()] == [(7, "a"), (8, "b")]
    assert [(r.finding_id, r.package_pos, r.pos, r.path) for r in nested.package_paths(docs).orderBy("pos").collect()] == [("b", 0, 0, None), ("b", 0, 1, "q")]
    assert [(r.pos, r.path) for r in nested.locations(docs).orderBy("pos").collect()] == [(0, None), (1, None), (2, "p"), (3, None)]
    assert [(r.kind, r.pos, r.identifier) for r in nested.identifiers(docs).where("identifier is not null").orderBy("kind").collect()] == [("cve", 0, "C"), ("cwe", 1, "W")]
    assert nested.packages(docs).first().name == "n"


def test_plain_fields(spark):
    raw = '{"findings":[{"id":"a","scanner":"{\\"name\\":\\"n\\",\\"version\\":\\"2\\"}","evidence":"e","location":{"path":"p","startLine":3.7,"endLine":4,"startColumn":"5"},"metadata":{"k":1.5,"t":"x","packages":[],"n":null}}]}'
    made = nested.tables(spark.createDataFrame([(1, raw), (1, raw), (2, None)], "report_id long, raw string"))
    (f,) = made["findings"].collect()
    assert (f.scanner_name, f.scanner_version, f.rule_id, f.evidence, f.remediation) == ("n", "2", None, "e", None)
    (x,) = made["locations"].collect()
    assert (x.start_line, x.end_line, x.start_column, x.end_column) == (None, 4, None, None)
    assert sorted((r.key, r.text, r.number) for r in made["metadata"].collect()) == [("k", None, 1.5), ("n", None, None), ("t", "x", None)]
    assert {(r.child, r.orphans) for r in nested.links(made).collect()} == {(n, 0) for n in ("locations", "identifiers", "metadata", "packages", "package_paths")}


def test_empty(spark):
    assert nested.leaves(spark.createDataFrame([], "report_id long, raw string")).count() == 0
