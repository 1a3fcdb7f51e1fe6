"""The corpus pipeline: quality, near duplicates, benchmark passages, source weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes
every stage's rows as Parquet in the shared checkpoint folder and reads them again. Of every stage holds: other columns than those
named are carried along, also under names that the operators use themselves; repeated rows each count as rows; an empty
table gives an empty table; whole texts are read, whatever their length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftstone.session import checkpoints, remove, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the graded model keeps.

    A null or empty text is scored by its lack of words; a null doc_id is never learned from but scored. Equal texts are kept or
    rejected together; a chance that equals the threshold keeps. Without labels all is kept.
    """
    from siftstone.llm import quality

    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_from(docs, quality.grade_of(labels)))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates (five words, similarity 0.8).

    Documents without words are nobody's duplicate and stay, and so do rows without a doc_id. A similarity of just 0.8 links. Repeated
    rows and other rows with one doc_id are one document: they stay or go together.
    """
    from siftstone.llm import neardup

    ship(spark)
    return neardup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole 13-word window of a benchmark item, and with less than a twentieth of their words in windows of any length.

    Null and empty texts stay; equal texts stay or go together; without benchmark items all stay.
    """
    from siftstone.llm import decontaminate

    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, some twice or more and some not at all, so that sources have their weights.

    A null source is a source of its own. Texts without words aren't taken. Rows alike in doc_id, source and text are taken alike.
    """
    from siftstone.llm import mixing

    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their size, shard and slot, in contiguous shards of near-equal bytes.

    A null text has size 1. Ties in doc_id are laid by checksum, then size; rows alike in all of these may swap slots. Columns of
    ``docs`` that are named like an added one are replaced.
    """
    from siftstone.llm import sharding

    return sharding.placed(docs)


STAGES = [("quality", quality_stage), ("neardup", neardup_stage), ("decontaminate", decontaminate_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: Models and seeded hashes are not expressible in SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of the folder. What a stage wrote is removed once the next one has written."""
    folder = f"{checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
