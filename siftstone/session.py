"""Session helper for local runs, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that every entry point assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SIFTSTONE_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


#: Rows of an Arrow batch: rows hold whole texts and files here. Used where the session has Spark's default.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch at most, beyond its last row.
BATCH_BYTES = 64 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python (once per application), where it isn't installed there, and keeps Arrow batches small."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if int(re.sub(r"\D", "", spark.conf.get(_BATCH_BYTES, "1"))) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        place = os.path.join(tempfile.mkdtemp(prefix="siftstone-"), "siftstone.zip")
        with zipfile.ZipFile(place, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(place)
        _shipped.add(context.applicationId)
    return spark


#: A table of at most so many bytes may be a single row group, which one task would read.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, for work that costs more than its shuffle; larger ones as they are, since their scan has tasks enough."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def checkpoints(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir. Where none is set, a local master gets one of its own (as in tests); a cluster gets an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="siftstone-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this session wrote, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; survives lost executors."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
