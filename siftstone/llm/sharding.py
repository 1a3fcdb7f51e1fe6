"""Contiguous shards of near-equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.shared import cut, running

SHARDS = 8


def _measures() -> tuple[Column, Column]:
    octets = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return (F.octet_length(octets) + 1).cast("long").alias("size"), F.crc32(octets).alias("text_crc32")


def _laid(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds shard and slot to rows with a size, laid end to end in that order."""
    ordered = cut(running(rows, [], order, {"before": F.col("size"), "nth": F.lit(1)}))
    total = ordered.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    out = ordered.withColumn("shard", F.least(F.expr(f"((2 * before + size) * {shards}) div {2 * total}L"), F.lit(shards - 1)).cast("int"))
    first = out.groupBy("shard").agg(F.min("nth").alias("first"))  # a row per shard
    return out.join(F.broadcast(first), "shard").withColumn("slot", (F.col("nth") - F.col("first")).cast("long")).drop("before", "nth", "first")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    size is the UTF-8 bytes of the text (null: none) plus 1. Rows in order of doc_id (null first), then
    checksum and size, are laid end to end; a row's shard is the one of ``shards`` equal stretches of the total that holds
    the row's middle byte, so shards are contiguous and differ from the mean by less than the largest row.
    slot counts a shard's rows from 0. law is ``bytes``; grown_shard is null under it. Equal texts are not kept together: they lie
    where their doc_id does. Rows alike in all of that may swap slots, and fall into two shards where a cut runs through them. Texts of
    any length are measured whole; an empty table gives none. Other columns are ignored.

    Sums run over range partitions with the partitions' totals ahead: no global sort in one task.
    """
    rows = _laid(docs.select("doc_id", *_measures()), ["doc_id", "text_crc32", "size"], shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs``, all columns, with size, shard and slot as in ``shard`` (columns of these names are replaced).

    Only keys and sizes are laid out; texts are written once, with a number for each row, and join their places by it.
    """
    numbered = cut(docs.drop("size", "shard", "slot").withColumn("_row", F.monotonically_increasing_id()))
    places = _laid(numbered.select("_row", "doc_id", *_measures()), ["doc_id", "text_crc32", "size", "_row"], shards)
    return numbered.join(places.select("_row", "size", "shard", "slot"), "_row").drop("_row")
