"""The queries of this package over a data folder, and the same in SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import letters_and_digits
from quillon.llm import batches, folding, mixing, packing, subjects, survivors, terms
from quillon.llm.tokens import sized
from quillon.operators.dedupe import once
from quillon.session import configure, staged
from quillon.sources.reports import table

Query = Callable[[SparkSession, str], DataFrame]

#: Tokens of a container, and tokens of the mix where it is fixed.
CAPACITY = 2048


def _terms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The lists of terms by record and field, and the number of records."""
    configure(spark)
    rows = once(table(spark, folder, "findings").select("id", F.col("scanner.rule_id").alias("rule_id"), "identifiers.cve", "identifiers.cwe", "category"), "id")
    plain = lambda values: F.transform(values, letters_and_digits)
    fields = F.array(
        F.struct(F.lit("rule_id").alias("field"), plain(F.array("rule_id")).alias("tokens")),
        F.struct(F.lit("category").alias("field"), plain(F.array("category")).alias("tokens")),
        F.struct(F.lit("cve").alias("field"), plain(F.col("cve")).alias("tokens")),
        F.struct(F.lit("cwe").alias("field"), plain(F.col("cwe")).alias("tokens")),
    )
    return rows.select("id", F.inline(fields)), rows.agg(F.count("*").alias("total"))


#: Terms of the longest run of terms counted in a record's list.
RUN = 2


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, records and mark of every term of the four fields."""
    lists, total = _terms(spark, folder)
    return terms.marked(terms.ngrams(lists, RUN).where("size = 1"), total).select("field", F.col("gram").alias("term"), "occurrences", "records", "mark")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every two terms that stand behind each other in a record's list."""
    return terms.ngrams(_terms(spark, folder)[0], RUN).where("size = 2").select("field", F.col("gram").alias("pair"), "occurrences", "records")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark is not null").select("field", "term", "mark")


def p1_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of all runs of one to three words in the documents."""
    configure(spark)
    docs = once(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    lists = docs.select(F.lit("text").alias("field"), F.split(batches.words(F.col("text")), " ").alias("tokens"))
    return terms.ngrams(lists, 3).select("size", "gram", "occurrences", "records")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return batches.repeats(table(spark, folder, "scans"), table(spark, folder, "batch_findings"))


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    rows = once(table(spark, folder, "findings").select("id", "title", F.col("location.path").alias("path"), "identifiers.cve"), "id")
    return folding.copies(rows.where("id is not null"), ["title", "path"], ["cve"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each group of copies: its smallest id and how many there are."""
    return _copies(spark, folder).groupBy("first_id").agg((F.count("*") + 1).alias("copies"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return survivors.best_fields(table(spark, folder, "group_members"))


def p6_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each fingerprint, its gaps filled from the layers."""
    configure(spark)
    return survivors.survivors(table(spark, folder, "group_members"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    docs = sized(once(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"))
    return packing.packed(docs.select(F.col("doc_id").alias("item"), F.col("tokens").alias("size")), CAPACITY)


def p7_placements(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each piece of one above the capacity."""
    return _packed(spark, folder).select("container", F.col("item").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("tokens"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """What each container holds and leaves unused."""
    return packing.containers(_packed(spark, folder), CAPACITY)


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    configure(spark)
    docs = sized(once(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id"))
    return mixing.mixed(docs, table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document of the mix is used."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    mix, report = _mixed(spark, folder)
    used = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("uses"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = used.agg(F.sum("tokens").alias("all"))
    joined = report.drop("tokens", "actual_share").join(used, "source", "left").withColumn("all", total.scalar())
    return joined.select("source", "target_share", "wanted_share", "max_repeats", "available", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"))


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    docs = table(spark, folder, "documents")
    model = subjects.fitted(docs, table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))
    return subjects.assigned(once(docs.select("doc_id", "text"), "doc_id"), model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each subject, and their share of all documents."""
    total = table(spark, folder, "documents").agg(F.countDistinct("doc_id").alias("all"))
    counted = _assigned(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))
    return counted.select("subject", "documents", (F.col("documents") / total.scalar()).alias("share"))


def _broken(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, broken: how many rows break each rule; each frame holds those that do."""
    out: DataFrame | None = None
    for name, df in rules.items():
        counted = df.agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))
        out = counted if out is None else out.unionByName(counted)
    return out


def p3_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the repeats of batches: the records that break a rule, and how many share a fingerprint with an
    earlier one of their repository."""
    configure(spark)
    scans, findings = table(spark, folder, "scans"), table(spark, folder, "batch_findings")
    rows = staged(batches.records(scans, findings))
    found = staged(batches.repeats(scans, findings))
    of = lambda x: rows.select(*(F.col(c).alias(f"{c}_{x}") for c in ("repo", "at", "print")), F.col("rec_id").alias(f"id_{x}"))
    both = staged(found.join(of("a"), "id_a").join(of("b"), "id_b").select("*", F.when(F.col("at_a") < F.col("at_b"), F.col("id_b")).otherwise(F.col("id_a")).alias("repeat"), F.when(F.col("at_a") < F.col("at_b"), F.col("id_a")).otherwise(F.col("id_b")).alias("first")))
    prints = rows.where("print is not null").groupBy("repo", "print").agg(F.min("at").alias("since"))
    return _broken({
        "both records have a batch": found.join(both, ["id_a", "id_b"], "left_anti"),
        "both are of one repository": both.where("repo_a <> repo_b"),
        "one is of an earlier batch": both.where("at_a = at_b"),
        "what is repeated repeats nothing": both.select(F.col("first").alias("id")).distinct().join(both.select(F.col("repeat").alias("id")), "id", "left_semi"),
        "a fingerprint is accepted in one batch": rows.where("print is not null").join(both.select(F.col("repeat").alias("rec_id")), "rec_id", "left_anti").groupBy("repo", "print").agg(F.countDistinct("at").alias("n")).where("n > 1"),
        "a fingerprint seen before, or not": rows.join(prints, ["repo", "print"]),
    })


def p7_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for containers: the rows that break a rule, and the number of documents placed."""
    placed = staged(_packed(spark, folder))
    docs = sized(once(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"))
    whole = staged(placed.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"), F.countDistinct("start").alias("starts")).join(docs.withColumnRenamed("doc_id", "item"), "item"))
    return _broken({
        "no container holds more than fits": packing.containers(placed, CAPACITY).where("unused < 0"),
        "all of a document is placed": whole.where("size <> tokens or starts <> pieces"),
        "only what is too long is split": whole.where(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("tokens") / CAPACITY))),
        "documents placed": placed.select("item").distinct(),
    })


def p8_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the mix: the rows that break a rule, and the number of targets."""
    mix, report = _mixed(spark, folder)
    mix, report = staged(mix), staged(report)
    own = once(table(spark, folder, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("own")), "doc_id")
    uses = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    return _broken({
        "no document is used beyond the cap": mix.join(report.select("source", "max_repeats"), "source").where("repeats < 1 or repeats > max_repeats"),
        "a document counts for its source": mix.join(own, "doc_id").where("not source <=> own"),
        "a document is listed once": mix.groupBy("doc_id").count().where("count > 1"),
        "the sizes are those reported": report.join(uses, "source", "left").where("coalesce(used, 0) <> tokens"),
        "the shares are met to within two documents": report.withColumn("all", report.agg(F.sum("tokens").alias("t")).scalar()).withColumn("longest", mix.agg(F.max("tokens").alias("t")).scalar()).where("abs(tokens - wanted_share * all) > 2 * longest"),
        "targets": report,
    })


def p9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for subject areas: the rows that break a rule, and the number of subjects."""
    found = staged(_assigned(spark, folder))
    named = table(spark, folder, "subjects").select("subject").distinct()
    return _broken({
        "subjects are those of the table": found.join(named, "subject", "left_anti"),
        "a subject is given once": found.groupBy("doc_id", "subject").count().where("count > 1"),
        "documents have text": found.join(table(spark, folder, "documents").where("text is not null and trim(text) <> ''"), "doc_id", "left_anti"),
        "a good part deals with it": found.where(F.col("share") < subjects.PART - 1e-9),
        "subjects": named,
    })


def queries() -> dict[str, Query]:
    found = (p1_found, p1_terms, p1_pairs, p1_ngrams, p3_found, p4_found, p4_groups, p6_found, p6_survivors, p7_placements, p7_containers, p8_mix, p8_shares, p9_found, p9_composition, p3_rules, p7_rules, p8_rules, p9_rules)
    return {f.__name__: f for f in found}


_PLAIN = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_TERMS = f"""WITH f AS (SELECT DISTINCT ON (id) id, scanner.rule_id AS rule_id, category, identifiers.cve AS cve, identifiers.cwe AS cwe FROM findings),
t AS (SELECT id, 'rule_id' AS field, rule_id AS v FROM f UNION ALL SELECT id, 'category', category FROM f UNION ALL SELECT id, 'cve', unnest(cve) FROM f UNION ALL SELECT id, 'cwe', unnest(cwe) FROM f),
p AS (SELECT id, field, {_PLAIN.format("v")} AS term FROM t),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM p WHERE term <> '' GROUP BY field, term),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM f) THEN 'common' END AS mark FROM c)"""
_PAIRS = f"""WITH f AS (SELECT DISTINCT ON (id) id, identifiers.cve AS cve, identifiers.cwe AS cwe FROM findings),
l AS (SELECT id, 'cve' AS field, cve AS v FROM f UNION ALL SELECT id, 'cwe', cwe FROM f),
t AS (SELECT id, field, list_filter(list_transform(v, lambda x: {_PLAIN.format("x")}), lambda x: x <> '') AS w FROM l),
p AS (SELECT id, field, w, unnest(range(1, len(w))) AS i FROM t)
SELECT field, w[i] || ' ' || w[i + 1] AS pair, count(*) AS occurrences, count(DISTINCT id) AS records FROM p GROUP BY ALL"""
_KEPT = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_COPIES = f"""WITH f AS (SELECT DISTINCT ON (id) id, title, location.path AS path, identifiers.cve AS cve FROM findings WHERE id IS NOT NULL),
k AS (SELECT id, coalesce({_KEPT.format("title")}, '') AS t, coalesce({_KEPT.format("path")}, '') AS p,
  coalesce(list_sort(list_filter(list_transform(cve, lambda x: coalesce({_KEPT.format("x")}, '')), lambda x: x <> '')), []) AS c FROM f),
g AS (SELECT id, min(id) OVER (PARTITION BY t, p, c) AS first_id FROM k)"""
_ADVICE = ", ".join(f"'{x}'" for x in survivors.NO_ADVICE)
_MEMBERS = f"""m AS (SELECT DISTINCT ON (member_id) * FROM group_members WHERE fingerprint IS NOT NULL AND member_id IS NOT NULL),
s AS (SELECT *, CASE lower(severity) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS sev,
  CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 100 THEN -1 WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS conf,
  CASE WHEN {_PLAIN.format("remediation")} NOT IN ('', {_ADVICE}) THEN remediation END AS advice, count(*) OVER (PARTITION BY fingerprint) AS n FROM m)"""
_BEST = f"""WITH {_MEMBERS}
SELECT fingerprint, 'primary' AS field, member_id FROM s WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY sev DESC, conf DESC, observed_at ASC NULLS LAST, advice IS NULL, member_id) = 1
UNION ALL SELECT fingerprint, 'remediation', member_id FROM s WHERE n > 1 AND advice IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY observed_at DESC NULLS LAST, sev DESC, conf DESC, member_id) = 1"""
# a cell's layer is the length of the longest chain of cells that dominate each other and end in it
_SURVIVORS = f"""WITH RECURSIVE {_MEMBERS},
x AS (SELECT *, (sev > 0)::INT + (conf >= 0)::INT + (advice IS NOT NULL)::INT AS complete, coalesce(date_diff('day', DATE '1970-01-01', observed_at::DATE), -1000000) AS day FROM s),
c AS (SELECT DISTINCT fingerprint, sev, conf, complete, day FROM x),
d AS (SELECT *, 1 AS layer FROM c UNION SELECT b.*, d.layer + 1 FROM d JOIN c b ON b.fingerprint = d.fingerprint AND (d.sev, d.conf) >= (b.sev, b.conf) AND d.complete >= b.complete AND d.day >= b.day AND (d.sev, d.conf, d.complete, d.day) <> (b.sev, b.conf, b.complete, b.day)),
l AS (SELECT fingerprint, sev, conf, complete, day, max(layer) AS layer FROM d GROUP BY ALL),
o AS (SELECT x.*, row_number() OVER (PARTITION BY fingerprint ORDER BY layer, sev DESC, conf DESC, complete DESC, day DESC, member_id) AS place FROM x JOIN l USING (fingerprint, sev, conf, complete, day))
SELECT fingerprint, arg_min(member_id, place) AS member_id, coalesce(arg_min(lower(severity), place) FILTER (sev > 0), 'unknown') AS severity, arg_min(conf, place) FILTER (conf >= 0) AS confidence, arg_min(advice, place) FILTER (advice IS NOT NULL) AS remediation FROM o GROUP BY fingerprint"""
_NGRAMS = r"""WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
g AS (SELECT doc_id, n AS size, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS gram FROM i, (VALUES (1), (2), (3)) v(n) WHERE pos + n - 1 <= len(w))
SELECT size, gram, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY size, gram"""


_REPOSITORY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(target.repository_url), e' \t\n\r'), '^[a-z+]+://', ''), '^[^@/]*@', ''), '^([^/:]+):', '\1/'), '(\.git)?/*$', '')"""
_PRINTED = f"""(WITH s AS (SELECT DISTINCT ON (scan_id) scan_id, {_REPOSITORY} AS repo FROM scans WHERE feed = 'batch' AND started_at IS NOT NULL), r AS (SELECT DISTINCT ON (rec_id) rec_id, scan_id, fingerprint FROM batch_findings)
SELECT count(*) FROM r JOIN s USING (scan_id) WHERE repo <> '' AND trim(fingerprint) <> '')"""


def _rules(*kept: str, **counted: str) -> str:
    """The rules that no row may break, and those for which SQL counts rows."""
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, CAST({value} AS BIGINT) AS broken" for name, value in {**dict.fromkeys(kept, "0"), **counted}.items())


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
        "p1_terms": f"{_TERMS} SELECT field, term, occurrences, records, mark FROM m",
        "p1_pairs": _PAIRS,
        "p1_ngrams": _NGRAMS,
        "p4_found": f"{_COPIES} SELECT first_id AS id_a, id AS id_b FROM g WHERE id <> first_id",
        "p4_groups": f"{_COPIES} SELECT first_id, count(*) AS copies FROM g GROUP BY first_id HAVING count(*) > 1",
        "p6_found": _BEST,
        "p6_survivors": _SURVIVORS,
        "p3_rules": _rules("both records have a batch", "both are of one repository", "one is of an earlier batch", "what is repeated repeats nothing", "a fingerprint is accepted in one batch", **{"a fingerprint seen before, or not": _PRINTED}),
        "p7_rules": _rules("no container holds more than fits", "all of a document is placed", "only what is too long is split", **{"documents placed": "(SELECT count(DISTINCT doc_id) FROM documents)"}),
        "p8_rules": _rules("no document is used beyond the cap", "a document counts for its source", "a document is listed once", "the sizes are those reported", "the shares are met to within two documents", targets="(SELECT count(*) FROM mix_targets)"),
        "p9_rules": _rules("subjects are those of the table", "a subject is given once", "documents have text", "a good part deals with it", subjects="(SELECT count(*) FROM subjects)"),
    }
