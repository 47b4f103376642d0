"""The deterministic identity of a finding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import or_empty, present, trim_blanks


def identifier_set(identifiers: Column) -> Column:
    """All identifiers of the four kinds, trimmed, in lower case, sorted and joined with commas.

    Repeated identifiers stay. Missing lists count as empty, and so does a missing struct. A null in a list counts as
    an empty text.
    """
    none = F.array().cast("array<string>")
    every = F.concat(*(F.coalesce(identifiers[kind], none) for kind in ("cwe", "cve", "osv", "ghsa")))
    return F.array_join(F.array_sort(F.transform(every, lambda v: F.lower(trim_blanks(or_empty(v))))), ",")


def computed_fingerprint(category: Column, rule_id: Column, location: Column, identifiers: Column, title: Column) -> Column:
    """SHA-256 over category, rule, path, start line, identifiers and title, joined with a pipe.

    Category and rule count as written, the path in lower case, the title trimmed and in lower case. Missing parts are
    empty; line 0 is '0'.
    """
    parts = (
        or_empty(category),
        or_empty(rule_id),
        or_empty(F.lower(location["path"])),
        or_empty(location["start_line"].cast("string")),
        identifier_set(identifiers),
        or_empty(F.lower(trim_blanks(title))),
    )
    return F.sha2(F.concat_ws("|", *parts), 256)


def fingerprint(given: Column, category: Column, rule_id: Column, location: Column, identifiers: Column, title: Column) -> Column:
    """The given fingerprint unless it is missing or empty, else the computed one."""
    return F.coalesce(present(given), computed_fingerprint(category, rule_id, location, identifiers, title))


def finding_fingerprint() -> Column:
    """``fingerprint`` over the columns of the finding schema."""
    return fingerprint(
        F.col("fingerprint"), F.col("category"), F.col("scanner")["rule_id"], F.col("location"), F.col("identifiers"), F.col("title")
    )
