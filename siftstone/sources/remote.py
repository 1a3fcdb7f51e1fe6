"""Files of any file system that Spark can read: object stores, HDFS, mounted shares."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.sources.tree import OVERSIZE


def files(spark: SparkSession, url: str, pattern: str | None = None, most: int = OVERSIZE) -> DataFrame:
    """(path, content) of the files below a URL, recursively, whose names match the glob; content is null for files of over ``most`` bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(url).select("path", F.when(F.col("length") <= most, F.col("content")).alias("content"))


def host(url: str) -> str:
    """The host or bucket of a URL; empty for a local path."""
    return urlsplit(url).hostname or ""
