"""The filter grammar over findings, and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.severity import weight, worst_first

FIELDS = ("rule", "cwe", "severity", "path")


def parse(query: str) -> tuple[str, str]:
    """("all", ""), (field, value), ("run", name) or ("text", words); ValueError for another field."""
    query = query.strip()
    if not query:
        return "all", ""
    field, sign, value = query.partition("=")
    field, value = field.strip(), value.strip()
    if not sign:
        return "text", query
    if field == "run" or field in FIELDS:
        return field, value
    raise ValueError(f"unknown field {field!r}: use one of {', '.join((*FIELDS, 'run'))}")


def matching(findings: DataFrame, query: str, scans: DataFrame | None = None, includes: DataFrame | None = None) -> DataFrame:
    """Findings that a query selects: k=v (exact), run=name (files of scans so named), or text that the rule name holds."""
    kind, value = parse(query)
    if kind == "all":
        return findings
    if kind == "text":
        return findings.where(F.col("rule").contains(value))
    if kind == "run":
        files = includes.join(scans.where(F.col("name") == value).select("scan_id"), "scan_id", "left_semi").select(F.col("hash").alias("file_hash"))
        return findings.join(files, "file_hash", "left_semi")
    return findings.where(F.col(kind) == value)


def search(findings: DataFrame, query: str, scans: DataFrame | None = None, includes: DataFrame | None = None, seq: str = "finding_id") -> DataFrame:
    """The selected findings worst first, then by place, rule and ``seq``."""
    place = [c for c in ("path", "line", "col", "rule") if c in findings.columns]
    return matching(findings, query, scans, includes).orderBy(worst_first(F.col("severity")), *place, seq)


def rules_matching(rules: DataFrame, query: str) -> DataFrame:
    """Rules whose name, description or weakness holds the query (any case), or whose severity it is."""
    q = query.strip().lower()
    held = F.lit(False)
    for field in ("name", "description", "cwe"):
        held = held | F.coalesce(F.lower(field).contains(q), F.lit(False))
    return rules.where(held | F.coalesce(F.lower("severity") == q, F.lit(False)))


def under(path: Column, root: str) -> Column:
    root = root.rstrip("/") or "/"
    return (path == root) | path.startswith(root if root == "/" else f"{root}/")


def breaching(findings: DataFrame, least: str, root: str, path: str = "path") -> DataFrame:
    """Findings at or over a severity, under a root: what makes a gate fail."""
    return findings.where((weight(F.col("severity")) >= weight(F.lit(least))) & under(F.col(path), root))


def records(table: DataFrame, key: str, label: Column, limit: int) -> DataFrame:
    """(id, label) of a table's first rows."""
    return table.select(F.col(key).alias("id"), label.alias("label")).limit(limit)
