"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftstone.plans import detection, fixtures, ranking, stored

_PARTS = (detection, stored, ranking, fixtures)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where personal data is concentrated: the directories with the most findings, their risk and share."""
    return detection.QUERIES["hotspots"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.SQL.items()}
