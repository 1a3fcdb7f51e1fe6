"""Links of pages, and a crawl over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.matching import java
from siftstone.functions.names import host_of

ATTRIBUTE = r"(?i)(?:href|src)\s*=\s*[\"']([^\"']+)[\"']"
PAGES, DEPTH = 64, 2


def resolved(base: Column, link: Column) -> Column:
    """An absolute http(s) address of a link on a page; null for fragments and other schemes."""
    link = F.trim(link)
    root = F.concat(F.substring_index(base, "://", 1), F.lit("://"), F.regexp_extract(base, r"://([^/?#]*)", 1))
    other = link.contains(":") & ~F.substring_index(link, ":", 1).contains("/") & ~link.startswith("//")
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike("^https?://"), link)
        .when(other | ~base.contains("://"), None)
        .when(link.startswith("/"), F.concat(root, F.lit("/"), F.expr("substring(_l, 2)")))
        .otherwise(F.concat(F.regexp_replace(base, "/[^/]*$", ""), F.lit("/"), link))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link) of every distinct link of every page."""
    rows = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(java(ATTRIBUTE)), F.lit(1))).alias("_l")).withColumn("_l", F.trim("_l"))
    return rows.select("url", resolved(F.col("url"), F.col("_l")).alias("link")).where("link is not null").distinct()


def crawl(pages: DataFrame, start: DataFrame, depth: int = DEPTH, limit: int = PAGES) -> DataFrame:
    """(url, depth) of pages reached from the start pages over links on the same host, breadth first, ``limit`` per start host."""
    edges = links(pages).where(host_of(F.col("url")) == host_of(F.col("link")))
    reached = start.select("url").distinct().withColumn("depth", F.lit(0))
    front = reached
    for level in range(1, depth + 1):
        front = front.join(edges, "url").select(F.col("link").alias("url")).distinct().join(pages.select("url").distinct(), "url", "left_semi").join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))
        reached = reached.union(front)
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(host_of(F.col("url"))).orderBy("depth", "url"))
    return reached.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")
