"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.shared import attach, cut, fits, running

#: Weights of sources by code point, in turn; tokens of the mix per token there is; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Least blocks of the mix, shards they are spread over, and the seed of the selection.
BLOCKS, SHARDS, SEED = 1 << 16, 8, 17
#: Blocks that the smallest target has at least, as far as its words go: half a block is the most that a source is off by.
FINEST = 256
#: Most words of a stretch, which is drawn as a whole, and stretches that a source has at least, as far as its words go.
STRETCH, STRETCHES = 1024, 64


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, passes: float = PASSES) -> np.ndarray:
    """Shares of share * sum(sizes) by weight; what exceeds passes * size goes to the others by weight until none does."""
    out, total = np.zeros(len(sizes)), share * float(sizes.sum())
    open_ = sizes > 0
    left = total
    while open_.any():
        part = np.where(open_, left * weights / weights[open_].sum(), 0)
        over = open_ & (part > passes * sizes)
        if not over.any():
            return np.where(open_, part, out)
        out[over] = passes * sizes[over]
        left = total - out.sum()
        open_ &= ~over
    return out


def apportion(goals: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Lague: ``seats`` go one by one to the highest goal / (2 * held + 1); ties to the first.

    Each holder surely has the seats below the final divisor, found by bisection; the few left are dealt by quotient.
    """
    if seats <= 0 or goals.sum() <= 0:
        return np.zeros(len(goals), np.int64)
    low, high = 0.0, 4.0 * float(goals.sum())
    for _ in range(200):
        middle = (low + high) / 2
        if np.floor(goals / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    held = np.floor(goals / high + 0.5).astype(np.int64)
    held = np.maximum(held - (goals / high + 0.5 - held < 1e-9), 0)
    while held.sum() < seats:
        quotient = goals / (2 * held + 1)
        # equal ones each take a seat before any of them takes another
        held[np.flatnonzero(quotient == quotient.max())[: int(seats - held.sum())]] += 1
    return held


def plan(sizes: np.ndarray, blocks: int = BLOCKS, shards: int = SHARDS, share: float = SHARE, passes: float = PASSES) -> tuple[np.ndarray, int, np.ndarray]:
    """Targets of sources of these sizes (in order of their names), the width of a block, and blocks by source and shard. Seats of a
    smaller house never exceed those of a larger, so a shard's quota is the difference of two apportionments.

    Blocks have one width over all sources, which follows the smallest target, so that each source comes near its own
    beside sources of any size. Only their number is computed; what is drawn are stretches of a source's own length.
    """
    goals = targets(sizes, np.array(WEIGHTS, float)[np.arange(len(sizes)) % len(WEIGHTS)], share, passes)
    width = max(1, min(int(-(-goals.sum() // blocks)), int(np.min(goals[goals > 0], initial=goals.sum()) // FINEST)))
    seats = int(goals.sum() // width)
    upto = [apportion(goals, seats * (k + 1) // shards) for k in range(shards)]
    return goals, width, np.diff(np.array([np.zeros(len(sizes), np.int64), *upto]), axis=0).T


def _sources(rows: DataFrame, blocks: int, shards: int) -> DataFrame:
    """(_name, source_size, target, _s, _upto, _stretch) of each source: its place by code point, null last, and the words that its shards end at.

    The driver sees two numbers of each source, and plans with arrays.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").cast("long").alias("n")).withColumn("_last", F.col("source").isNull())
    ranked = cut(running(totals, [], ["_last", "source"], {"_s": F.lit(1)}))
    known = ranked.select(F.col("_s").cast("long").alias("_s"), "n").toArrow().sort_by("_s")
    sizes = known.column("n").to_numpy()
    goals, width, quotas = plan(sizes, blocks, shards)
    upto = np.minimum(np.cumsum(quotas, axis=1) * width, (PASSES * sizes)[:, None])
    ends = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * shards), pa.array(upto.ravel()))
    planned = spark.createDataFrame(pa.table({"_s": known.column("_s"), "target": pa.array(goals), "_upto": ends}))
    stretch = F.least(F.greatest(F.expr(f"n div {STRETCHES}"), F.lit(1)), F.lit(STRETCH)).alias("_stretch")
    return cut(ranked.join(planned, "_s").select(F.col("source").alias("_name"), F.col("n").alias("source_size"), "target", F.col("_s").cast("long").alias("_s"), "_upto", stretch))


def _sized(docs: DataFrame) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return docs.select("doc_id", "source", F.size(words).cast("long").alias("size"), F.xxhash64("text").alias("_text"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(sources) if fits(sources) else sources, F.col("source").eqNullSafe(F.col("_name")))


def mix(docs: DataFrame, seed: int = SEED, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard_words) per row of ``docs``.

    size counts words (null text: 0). Sainte-Lague gives each source an integer quota of equal-token blocks for each
    shard, in proportion to its target. A source's words, in order of doc_id, are cut into stretches, and these are drawn in order of a
    seeded hash, all once before any of them twice, until its quotas are filled, shard after shard; the stretch that a quota ends in
    is divided there. taken is the words of a document that are drawn, repeats counted, at most 2 * size; shard_words are those that
    each shard gets. Reruns agree, also on rows in another order.

    Two numbers per source are brought to the driver. A null source is a source of its own, the last. Repeated rows count each; rows alike in
    doc_id and text lie next to each other, in any order. Texts without words get taken 0; texts of any length are counted whole; an
    empty table gives none. Other columns are ignored.
    """
    numbered = cut(_sized(docs).withColumn("_row", F.monotonically_increasing_id()))
    sources = _sources(numbered, blocks, shards)
    known = _with_source(numbered, sources)
    placed = cut(running(known.select("_s", "doc_id", "_text", "_row", "size", "_stretch", "source_size", "target", "_upto"), ["_s"], ["doc_id", "_text", "_row"], {"start": F.col("size")}))
    full = placed.where("size > 0")
    # each stretch once, at the row that its first word is in
    first, last = F.expr("(start + _stretch - 1) div _stretch"), F.expr("(start + size - 1) div _stretch")
    every = full.where(first <= last).select("_s", "_stretch", "source_size", F.explode(F.sequence(first, last)).alias("_block"))
    every = every.select("_s", "_block", F.least("_stretch", F.col("source_size") - F.col("_block") * F.col("_stretch")).alias("_words"), F.xxhash64(F.lit(seed), "_s", "_block").alias("_hash"))
    drawn = running(every, ["_s"], ["_hash", "_block"], {"_ahead": F.col("_words")}).select("_s", "_block", "_ahead")
    spans = full.select("_row", "_s", "start", "size", "_stretch", "source_size", "_upto", F.explode(F.sequence(F.expr("start div _stretch"), last)).alias("_block"))
    parts = spans.join(drawn, ["_s", "_block"])
    # the draw of a source is a line, on which a stretch lies once in each pass; quotas cut it
    at = F.col("_block") * F.col("_stretch")
    low = F.greatest("start", at)
    words = F.least(F.col("start") + F.col("size"), at + F.col("_stretch")) - low
    parts = parts.select("_row", "_upto", "source_size", (F.col("_ahead") + low - at).alias("_from"), words.alias("_n"))
    inside = lambda k: " + ".join(f"greatest(least({p} * source_size + _from + _n, _upto[{k}]) - greatest({p} * source_size + _from, {f'_upto[{k - 1}]' if k else '0L'}), 0L)" for p in range(PASSES))
    drawn = parts.groupBy("_row").agg(*[F.sum(F.expr(inside(k))).alias(f"_{k}") for k in range(shards)])
    by_shard = F.array(*[F.coalesce(f"_{k}", F.lit(0)).cast("long") for k in range(shards)])
    out = placed.join(drawn, "_row", "left").withColumn("shard_words", by_shard)
    return out.select("doc_id", "size", "source_size", "target", F.aggregate("shard_words", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), "shard_words")


def _fitted(rows: DataFrame) -> DataFrame:
    """Adds _more: 1 for the documents of each source that fill its _room in order of their hash, up to the first that doesn't fit."""
    laid = running(rows, ["_s"], ["_hash", "doc_id", "_text"], {"_ahead": F.col("size")})
    return cut(laid.withColumn("_more", F.expr("cast(_ahead + size <= _room as int)")))


def _rooms(ranked: DataFrame, name: str) -> DataFrame:
    """What the documents that fit have left of each source's room."""
    room = F.any_value("_room") - F.coalesce(F.max(F.when(F.col("_more") == 1, F.col("_ahead") + F.col("size"))), F.lit(0))
    return cut(ranked.groupBy("_s").agg(room.alias(name)))


def mixed(docs: DataFrame, seed: int = SEED, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs``, all columns, in so many copies that each source comes as near its quotas as whole documents can.

    All documents of a source are taken as often as its quota holds the whole source; the rest goes to documents in order of a
    seeded hash, up to the first that doesn't fit, and once more, in the gap before it, to those that aren't larger than it. What is
    then left is filled with the largest that fit of some others: three of each size class (a power of two), one row
    each, so that the gap shrinks to the size of a small document.
    Rows alike in doc_id, source and text are taken alike. Texts without words aren't taken; an empty table stays empty.
    """
    rows = cut(_sized(docs).groupBy("doc_id", "source", "_text", "size").agg(F.count("*").alias("_rows")).withColumn("size", F.col("size") * F.col("_rows")))
    known = _with_source(rows, _sources(rows, blocks, shards)).where("size > 0")
    quota = F.element_at("_upto", -1)
    known = known.select("_s", "doc_id", "source", "_text", "size", F.expr("element_at(_upto, -1) div source_size").alias("_whole"), F.pmod(quota, F.col("source_size")).alias("_rest"), F.xxhash64(F.lit(seed), "doc_id", "_text").alias("_hash"))
    ranked = _fitted(known.withColumnRenamed("_rest", "_room"))
    counted = ranked.select("_s", "doc_id", "source", "_text", (F.col("_whole") + F.col("_more")).cast("int").alias("_n"))
    later = attach(ranked.where("_more = 0").drop("_room", "_more", "_ahead"), _rooms(ranked, "_room"), ["_s"], "inner")
    # once more in the gap, with documents that fit into it
    ranked = _fitted(later.where("size <= _room"))
    counted = counted.union(ranked.where("_more = 1").select("_s", "doc_id", "source", "_text", "_more"))
    later = later.where("size > _room").unionByName(ranked.where("_more = 0").drop("_more", "_ahead"))
    later = attach(later, _rooms(ranked, "_gap"), ["_s"], "left").withColumn("_gap", F.coalesce("_gap", "_room")).where("size <= 2 * _gap")
    some = later.groupBy("_s", "_gap", F.floor(F.log2("size")).alias("_class"), F.pmod("_hash", F.lit(3)).alias("_third")).agg(F.min(F.struct("_hash", "size", "doc_id", "source", "_text")).alias("_d"))
    some = some.groupBy("_s", "_gap").agg(F.sort_array(F.collect_list(F.struct("_d.size", "_d.doc_id", "_d.source", "_d._text")), False).alias("_d"))  # three of a class at most
    fill = (
        "aggregate(_d, named_struct('gap', _gap, 'i', 1, 'out', slice(_d, 1, 0)), (a, x) -> if(x.size <= a.gap or (a.i = size(_d) and x.size <= 2 * a.gap), "
        "named_struct('gap', a.gap - x.size, 'i', a.i + 1, 'out', concat(a.out, array(x))), named_struct('gap', a.gap, 'i', a.i + 1, 'out', a.out)), a -> a.out)"
    )
    filled = some.select("_s", F.explode(F.expr(fill)).alias("_d")).select("_s", "_d.doc_id", "_d.source", "_d._text", F.lit(1).alias("_n"))
    copies = cut(counted.union(filled).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_of"), F.col("_text").alias("_t")).agg(F.sum("_n").cast("int").alias("_copies")).where("_copies > 0"))
    keyed = docs.withColumn("_k", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("_k") == F.col("_t"))
    out = keyed.join(F.broadcast(copies) if fits(copies) else copies, same)
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
