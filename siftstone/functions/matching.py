"""Locating matches and rendering snippets, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a snippet at most, and around the match; fixed values.
SNIPPET, CONTEXT, BULLET = 200, 80, "•"

HITS = "array<struct<col:int,value:string>>"


def java(pattern: str) -> str:
    """The pattern with Unicode classes, as detectors mean \\d, \\s and \\w."""
    return f"(?U){pattern}"


def sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lines(text: str | Column) -> Column:
    """Lines as array: split at LF, a trailing CR dropped, no line after a final LF; null for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(text == "", F.slice(parts, 1, 0)).otherwise(parts)


def located(line: str, pattern: str) -> Column:
    """Every match in column ``line``, from left to right: 1-based character column and value."""
    p = sql(java(pattern))
    return F.expr(
        f"aggregate(zip_with(split({line}, {p}, -1), regexp_extract_all({line}, {p}, 0), (g, m) -> struct(length(g) as g, m as m)), "
        f"struct(1 as at, cast(array() as {HITS}) as out), (a, x) -> if(x.m is null, a, struct(a.at + x.g + length(x.m) as at, "
        "concat(a.out, array(struct(a.at + x.g as col, x.m as value))) as out)), a -> a.out)"
    )


def first(line: str, pattern: str) -> Column:
    """The first match as an array of at most one hit."""
    return F.slice(located(line, pattern), 1, 1)


def redact(value: Column) -> Column:
    """Up to 8 characters: bullets only (one at least); else the first and last four around at most 12 bullets."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit(BULLET), F.greatest(n, F.lit(1)))).otherwise(F.concat(F.substring(value, 1, 4), F.repeat(F.lit(BULLET), F.least(n - 8, F.lit(12))), F.substring(value, n - 3, F.lit(4))))


def window(line: Column, col: Column, value: Column, shown: Column) -> Column:
    """The line around a match with ``shown`` in its place: CONTEXT characters on each side, an ellipsis where cut, trimmed, clamped."""
    n = F.length(line)
    start = F.least(col - 1, n)
    end = F.least(start + F.length(value), n)
    low, high = F.greatest(start - CONTEXT, F.lit(0)), F.least(end + CONTEXT, n)
    whole = F.concat(
        F.when(low > 0, "…").otherwise(""),
        F.substring(line, low + 1, start - low),
        shown,
        F.substring(line, end + 1, high - end),
        F.when(high < n, "…").otherwise(""),
    )
    whole = F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(whole) > F.greatest(F.lit(SNIPPET), F.length(shown)), F.concat(F.substring(whole, 1, SNIPPET), F.lit("…"))).otherwise(whole)


def leaf(path: Column) -> Column:
    """Last part of a path after /, \\ and ! (container members)."""
    return F.element_at(F.split(path, r"[/\\!]"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix of the leaf, null if there is none (or only a leading dot)."""
    found = F.regexp_extract(leaf(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", F.lower(found))


def parent(path: Column) -> Column:
    """Directory of a path; '.' for none."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(found == "", "/").otherwise(found)
