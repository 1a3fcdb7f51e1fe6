"""Counts, risk and places of findings; normalised events; annotation."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.severity import weight
from siftstone.functions.tables import EVENTS
from siftstone.functions import matching as m

HOTSPOTS = 10


def totals(files: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, scans, findings."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(files, "files").join(one(scans, "scans")).join(one(findings, "findings"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n), worst first; unrated findings don't count."""
    return findings.where("severity is not null").groupBy("severity").agg(F.count("*").alias("n")).orderBy(weight(F.col("severity")).desc())


def risk_score(findings: DataFrame) -> DataFrame:
    """One row, risk: the sum of weights, 0 without findings."""
    return findings.agg(F.coalesce(F.sum(weight(F.col("severity"))), F.lit(0)).cast("long").alias("risk"))


def directory(path: Column) -> Column:
    """What comes before the last separator; '/' for the root, '.' without one."""
    head = F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)
    return F.when(~path.rlike(r"[/\\]"), ".").when(head == "", "/").otherwise(head)


def hotspots(findings: DataFrame, limit: int = HOTSPOTS) -> DataFrame:
    """(directory, findings, risk, share) of the directories with the most findings."""
    rows = findings.groupBy(directory(F.col("path")).alias("directory")).agg(F.count("*").alias("findings"), F.coalesce(F.sum(weight(F.col("severity"))), F.lit(0)).cast("long").alias("risk"))
    total = rows.agg(F.sum("findings").alias("_n"))  # one row, from the same shuffle
    rows = rows.join(F.broadcast(total))
    return rows.select("directory", "findings", "risk", (F.col("findings") / F.col("_n")).alias("share")).orderBy(F.desc("findings"), F.desc("risk"), "directory").limit(limit)


def common_directory(directories: list[str]) -> str:
    """What the directories (of a report's few hotspots) have in common, whole parts only."""
    if len(directories) < 2:
        return ""
    parts = [d.split("/") for d in directories]
    shared = os.path.commonprefix(parts)
    return "/".join(shared) if len(shared) > 1 or (shared and shared[0]) else ""


def by_severity_total(findings: DataFrame) -> DataFrame:
    """One row: total, and a count for each severity."""
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col("severity") == s, F.lit(False))).alias(s) for s in ("critical", "high", "medium", "low", "info")])


def event_of(rule: Column) -> Column:
    """(category, action) of a rule; detection, detected for rules of no group."""
    out = None
    for name, category, action in EVENTS:
        met = rule.startswith(name[:-1]) if name.endswith("*") else rule == name
        said = F.struct(F.lit(category).alias("category"), F.lit(action).alias("action"))
        out = F.when(met, said) if out is None else out.when(met, said)
    return out.otherwise(F.struct(F.lit("detection").alias("category"), F.lit("detected").alias("action")))


def events(findings: DataFrame) -> DataFrame:
    """(finding_id, category, action, signature, severity, src): normalised findings; src is the first address in the snippet."""
    key = [c for c in ("finding_id",) if c in findings.columns]
    src = F.regexp_extract("snippet", m.java(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), 0)
    return findings.withColumn("_e", event_of(F.col("rule"))).select(*key, "_e.category", "_e.action", F.col("rule").alias("signature"), F.coalesce("severity", F.lit("info")).alias("severity"), F.coalesce(src, F.lit("")).alias("src"))


def event_counts(rows: DataFrame) -> DataFrame:
    """(category, n), most first, then by name."""
    return rows.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def annotated(findings: DataFrame, cwe: DataFrame) -> DataFrame:
    """Findings with the name of their weakness as cwe_name (null if unknown)."""
    names = cwe.select(F.concat(F.lit("CWE-"), F.regexp_replace("id", "^CWE-", "")).alias("cwe"), F.col("name").alias("cwe_name")).dropDuplicates(["cwe"])
    return findings.join(names, "cwe", "left")


def scan_summary(results: DataFrame) -> DataFrame:
    """Counters of a scan over (status, matches) rows: status is scanned, unchanged, oversize, unreadable or skipped."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    candidates, skipped = F.count("*"), F.count_if(F.col("status") == "skipped")
    return results.agg(candidates.alias("candidates"), *[count(s) for s in ("scanned", "unchanged", "oversize", "unreadable", "skipped")], F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matches"), F.when(candidates > 0, (candidates - skipped) / candidates).otherwise(1.0).alias("coverage"))


def fingerprint(rules: DataFrame) -> DataFrame:
    """One row, ruleset: 16 hex digits over the sorted distinct name=pattern lines of the rules."""
    # a rule set is configuration, held by the driver as a whole
    line = F.concat_ws("=", "name", "pattern")
    return rules.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n").cast("binary"), 256), 1, 16).alias("ruleset"))
