"""Detectors over text: secrets, personal data and log events. Expressions only; no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import matching as m
from siftstone.functions.tables import LOG, LOG_NAMES, PERSONAL, SECRETS, Rule


#: What a line has wherever a rule of the set matches; much cheaper to look for than the rules.
HINTS = {
    PERSONAL: r"[@\p{Nd}]",
    SECRETS: r"A[KSBC][IC]A|PRIVATE KEY|gh[opusr]_|xox[baprs]-|://|(?iu:api|secret|auth)",
    LOG: r"Failed password|Invalid user|authentication failure|Accepted |COMMAND=|session opened|FAILED su",
}


def text_lines(files: DataFrame, anywhere: str | None = None, hint: str | None = None) -> DataFrame:
    """(path, line, content, ...) of every line; with ``anywhere``, of texts and lines that the pattern occurs in only. The ``hint`` is a cheaper one that
    occurs wherever that does: it is looked for first, and by itself in whole texts."""
    rows = files if anywhere is None else files.where(F.col("text").rlike(hint or anywhere))
    rows = rows.select("*", F.posexplode(m.lines("text")).alias("_at", "content")).withColumn("line", (F.col("_at") + 1).cast("int")).drop("_at", "text")
    if hint is not None:
        rows = rows.where(F.col("content").rlike(hint))
    return rows if anywhere is None else rows.where(F.col("content").rlike(anywhere))


def either(rules: tuple[Rule, ...]) -> str:
    return "(?U)" + "|".join(f"(?:{r.pattern})" for r in rules)


def hits(lines: DataFrame, rules: tuple[Rule, ...], only_first: bool = False, places: bool = True) -> DataFrame:
    """Adds rule_ord, rule, col, value, label, severity, cwe, cve: each match of each rule in each line.

    A rule's matches are looked for only in lines that it occurs in. Without ``places`` col is null, which saves locating them.
    """
    found = []
    for at, rule in enumerate(rules):
        pattern = F.lit(m.java(rule.pattern))
        if places:
            each = m.first("content", rule.pattern) if only_first else m.located("content", rule.pattern)
        else:
            each = F.array(F.regexp_extract("content", m.java(rule.pattern), 0)) if only_first else F.regexp_extract_all("content", pattern, F.lit(0))
            each = F.transform(each, lambda v: F.struct(F.lit(None).cast("int").alias("col"), v.alias("value")))
        meta = [F.lit(at).alias("rule_ord"), F.lit(rule.name).alias("rule"), F.lit(rule.description).alias("label"), F.lit(rule.severity).cast("string").alias("severity"), F.lit(rule.cwe).cast("string").alias("cwe"), F.lit(rule.cve).cast("string").alias("cve")]
        each = F.when(F.col("content").rlike(m.java(rule.pattern)), F.transform(each, _with(meta)))
        found.append(F.coalesce(each, F.array()))
    return lines.select("*", F.explode(F.concat(*found)).alias("_h")).select(*lines.columns, "_h.*")


def _with(meta: list[Column]):
    return lambda h: F.struct(h["col"].alias("col"), h["value"].alias("value"), *meta)


def _finding(rows: DataFrame, snippet: Column) -> DataFrame:
    extra = [c for c in ("file_hash", "file_seq") if c in rows.columns]
    return rows.select("rule", "path", "line", "col", snippet.alias("snippet"), "severity", "cwe", "cve", "rule_ord", *extra)


def secrets(files: DataFrame, rules: tuple[Rule, ...] = SECRETS, show: bool = False) -> DataFrame:
    """Findings of fixed regex rules: every match of every rule, its value masked (unless ``show``) in its line."""
    rows = hits(text_lines(files, either(rules), HINTS.get(rules)), rules)
    shown = F.col("value") if show else m.redact(F.col("value"))
    return _finding(rows, m.window(F.col("content"), F.col("col"), F.col("value"), shown))


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ssn(value: Column) -> Column:
    area, group, serial = (F.get(F.split(value, "-"), i).cast("int") for i in range(3))
    return (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)


def iban(value: Column) -> Column:
    """15 to 34 signs whose number (first four last, letters as 10 to 35) is 1 modulo 97."""
    turned = F.split(F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.length(value).between(15, 34) & (F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1)


def personal(files: DataFrame, rules: tuple[Rule, ...] = PERSONAL, places: bool = True) -> DataFrame:
    """Findings of personal data, values masked under their label; card-like values keep their last four digits. Columns are null without ``places``."""
    rows = hits(text_lines(files, either(rules), HINTS.get(rules)), rules, places=places)
    v = F.col("value")
    valid = F.when(F.col("rule") == "pii-ssn", ssn(v)).when(F.col("rule") == "pii-credit-card", luhn(v)).when(F.col("rule") == "pii-iban", iban(v)).otherwise(True)
    digits = F.regexp_replace(v, "[^0-9]", "")
    card = v.rlike("^[0-9 -]+$") & (F.length(digits) >= 13)
    snippet = F.concat(F.col("label"), F.lit(": "), F.when(card, F.concat(F.lit(m.BULLET * 12), F.right(digits, F.lit(4)))).otherwise(m.redact(v)))
    return _finding(rows.where(valid), snippet)


def is_log(path: Column) -> Column:
    return (m.extension(path) == "log") | m.leaf(path).isin(*LOG_NAMES)


def log_events(files: DataFrame, rules: tuple[Rule, ...] = LOG, any_path: bool = False, places: bool = True) -> DataFrame:
    """Findings of log files: the first match of each pattern in each line, unmasked. Columns and snippets are null without ``places``."""
    rows = files if any_path else files.where(is_log(F.col("path")))
    rows = hits(text_lines(rows, either(rules), HINTS.get(rules)), rules, only_first=True, places=places)
    return _finding(rows, m.window(F.col("content"), F.col("col"), F.col("value"), F.col("value")))


def regex_rules(files: DataFrame, rules: list[Rule], show: bool = False, skipped: list[str] | None = None) -> DataFrame:
    """Findings of rules given at run time. A rule that uses look-around or back references, or doesn't compile, is
    skipped and its name added to ``skipped``; so is none of the fixed schemes (hashes, network values, feeds), which aren't regexes."""
    from siftstone.functions.schemes import scheme

    usable = []
    for rule in rules:
        if scheme(rule.pattern):
            continue
        try:
            if _unsupported(rule.pattern):
                raise ValueError(rule.pattern)
            files.sparkSession._jvm.java.util.regex.Pattern.compile(m.java(rule.pattern))
            usable.append(rule)
        except Exception:
            if skipped is not None:
                skipped.append(rule.name)
    if not usable:
        return files.sparkSession.createDataFrame([], "rule string, path string, line int, col int, snippet string, severity string, cwe string, cve string, rule_ord int")
    # one batch of rules per branch keeps the generated plans small
    parts = [secrets(files, tuple(usable[i : i + 40]), show) for i in range(0, len(usable), 40)]
    return reduce(DataFrame.unionByName, parts)


def _unsupported(pattern: str) -> bool:
    import re

    return bool(re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", pattern))
