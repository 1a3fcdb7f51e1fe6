"""Detection over streams of files: findings are written as they come, with progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftstone.sources import tree

Detector = Callable[[DataFrame], DataFrame]


def watch(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New and edited files of a folder as a stream of (path, text)."""
    schema = spark.read.format("binaryFile").load(folder).schema
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return rows.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "modificationTime", "length", tree.text().alias("text"))


def findings(files: DataFrame, detector: Detector, out: str, checkpoint: str, progress: Callable[[int, int], None] | None = None, once: bool = True, tally: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Writes the detector's findings of each batch under ``out`` as batch=n folders (a batch that is run again replaces its
    folder) and tells ``progress`` of each batch's number and findings, and ``tally`` of its findings by severity."""

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        detector(batch).write.mode("overwrite").parquet(path)
        if progress is None and tally is None:
            return
        counts = {r["severity"] or "info": r["count"] for r in batch.sparkSession.read.parquet(path).groupBy("severity").count().collect()}
        if progress is not None:
            progress(number, sum(counts.values()))
        if tally is not None:
            tally(number, counts)

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def severity_windows(rows: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings by severity in windows of event time (ts), with late rows up to a bound."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("n"))
