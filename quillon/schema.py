"""Types of the findings model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities and their weights.
SEVERITY_WEIGHTS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "unknown": 0}

ORD = "struct<scanner_seq:int,result_pos:int,class_rank:int,item_pos:int>"
SCANNER = "struct<name:string,version:string,rule_id:string>"
LOCATION = "struct<path:string,start_line:bigint,end_line:bigint,start_column:bigint,end_column:bigint>"
IDENTIFIERS = "struct<cwe:array<string>,cve:array<string>,osv:array<string>,ghsa:array<string>>"
TARGET = "struct<path:string,repository_url:string,commit_sha:string,branch:string>"


def finding_ddl() -> str:
    """One finding, as DDL."""
    return (
        f"scan_id string, ord {ORD}, id string, title string, description string, category string, severity string, "
        f"confidence double, scanner {SCANNER}, location {LOCATION}, identifiers {IDENTIFIERS}, evidence string, "
        "remediation string, fingerprint string, metadata string"
    )


def scan_ddl() -> str:
    """One scan header, as DDL."""
    return (
        f"scan_id string, scanner string, started_at timestamp, completed_at timestamp, target {TARGET}, "
        "diagnostics array<string>"
    )


def severity_weight(severity: Column) -> Column:
    """Weight of a severity; anything that is not one of the six names, nulls included, weighs 0."""
    weight = F.lit(0)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def normal_severity(severity: Column) -> Column:
    """The severity in lower case if it is one of the names, else 'unknown'. Blanks are not trimmed."""
    low = F.lower(severity)
    return F.when(low.isin(*SEVERITY_WEIGHTS), low).otherwise(F.lit("unknown"))
