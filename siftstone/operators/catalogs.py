"""The catalogue: rule sets, weaknesses, feeds, settings and models as small keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_id() -> Column:
    """Content id of a rule: a digest of its name and pattern."""
    return F.sha2(F.concat(F.coalesce("name", F.lit("")).cast("binary"), F.lit(b"\x00"), F.coalesce("pattern", F.lit("")).cast("binary")), 256)


def put_dataset(rules: DataFrame, edges: DataFrame, datasets: DataFrame, name: str, fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, from_dataset edges and datasets with a rule set put in place of the one of its name; rules are kept once by content."""
    fresh = fresh.withColumn("rule_id", rule_id()).dropDuplicates(["rule_id"])
    out_rules = rules.unionByName(fresh.select(*rules.columns)).dropDuplicates(["rule_id"])
    out_edges = edges.where(F.col("dataset") != name).unionByName(fresh.select("rule_id", F.lit(name).alias("dataset")))
    count = fresh.agg(F.lit(name).alias("name"), F.count("*").alias("rules"))
    return out_rules, out_edges, datasets.where(F.col("name") != name).unionByName(count)


def drop_dataset(edges: DataFrame, datasets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges and datasets without one; its rules stay."""
    return edges.where(F.col("dataset") != name), datasets.where(F.col("name") != name)


def rules_of(rules: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """Rules of a dataset, or of any."""
    chosen = edges if name is None else edges.where(F.col("dataset") == name)
    return rules.join(chosen.select("rule_id").distinct(), "rule_id", "left_semi")


def listed(table: DataFrame, key: str = "name") -> DataFrame:
    return table.orderBy(key)


def put(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the fresh rows in place of those with the same keys."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def drop(table: DataFrame, **keys: str) -> DataFrame:
    """The table without the rows of the given key values."""
    hit = F.lit(True)
    for k, v in keys.items():
        hit = hit & (F.col(k) == v)
    return table.where(~hit)


def weakness(cwe: DataFrame, ident: str) -> DataFrame:
    """The entry of ``798`` or ``CWE-798``."""
    number = ident.strip().upper().removeprefix("CWE-")
    return cwe.where(F.regexp_replace(F.upper("id"), "^CWE-", "") == number)


def put_events(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """Events, one per finding; a fresh one takes the place of the old."""
    return put(table, fresh, ["finding_id"])
