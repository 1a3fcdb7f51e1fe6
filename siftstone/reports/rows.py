"""Reports of any number of findings: a row per finding in a format, as expressions, written from the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.reports import LEVELS

_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"


def _said(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _severity() -> Column:
    return F.coalesce("severity", F.lit("info"))


def _place() -> Column:
    return F.concat(_said("path"), F.lit(":"), _said("line"), F.lit(":"), _said("col"))


def _cell(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"([|`])", r"\\$1"), r"[\x00-\x1F]", " ")


def _xml(value: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return F.regexp_replace(value, _CONTROLS, " ")


def _text() -> Column:
    return F.concat(F.lit("["), _said("rule"), F.lit("] "), _severity(), F.lit(" "), _place(), F.lit(" "), _said("snippet"))


def _json() -> Column:
    return F.to_json(F.struct("rule", "path", "line", "col", "snippet", "severity", "cwe"), {"ignoreNullFields": "false"})


def _markdown() -> Column:
    cells = (_cell(_severity()), _cell(_said("rule")), F.concat(_cell(_said("path")), F.lit(":"), _said("line"), F.lit(":"), _said("col")), _cell(_said("cwe")), _cell(_said("snippet")))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _junit() -> Column:
    message = F.concat(F.lit("["), _said("rule"), F.lit("] "), _severity(), F.when(F.col("cwe").isNotNull(), F.concat(F.lit(" ("), "cwe", F.lit(")"))).otherwise(""))
    name = F.concat(_said("rule"), F.lit(" at "), _place())
    return F.concat(
        F.lit('<testcase name="'), _xml(name), F.lit('" classname="'), _xml(_said("path")), F.lit('"><failure message="'), _xml(message), F.lit('" type="'), _severity(), F.lit('">'), _xml(_said("snippet")), F.lit("</failure></testcase>")
    )


def _sarif() -> Column:
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("severity")), F.lit("warning"))
    message = F.coalesce(F.nullif("snippet", F.lit("")), "rule")
    region = F.when(F.col("line") >= 1, F.struct(F.col("line").alias("startLine"), F.when(F.col("col") >= 1, F.col("col")).alias("startColumn"), F.when(F.col("snippet") != "", F.struct(F.col("snippet").alias("text"))).alias("snippet")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations")))


FORMATS = {"text": _text, "json": _json, "markdown": _markdown, "junit": _junit, "sarif": _sarif}


def rendered(findings: DataFrame, kind: str) -> DataFrame:
    """(line): each finding in a format: a line of text, a JSON object, a Markdown row, a JUnit case or a SARIF result. Missing values are empty (null in JSON)."""
    if kind not in FORMATS:
        raise ValueError(f"no rows in format {kind!r}: use one of {', '.join(FORMATS)}")
    return findings.select(FORMATS[kind]().alias("line"))


def write(findings: DataFrame, kind: str, folder: str) -> None:
    """All findings, in the order given, as text files of a folder (heads and tails of documents are left to whoever joins them)."""
    rendered(findings, kind).write.text(folder)
