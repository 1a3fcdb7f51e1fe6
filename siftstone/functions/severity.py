"""Severity weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.tables import SEVERITY


def weight(severity: Column) -> Column:
    """Weight of a severity; null for null or unknown."""
    out = None
    for name, value in SEVERITY.items():
        out = F.when(severity == name, value) if out is None else out.when(severity == name, value)
    return out


def worst_first(severity: Column) -> Column:
    """Descending sort key: weight + 1, unrated as 0."""
    return F.coalesce(weight(severity) + 1, F.lit(0)).desc()
