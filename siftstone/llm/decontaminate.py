"""Benchmark decontamination by winnowing: shared fingerprints, extended to exact windows. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.shared import attach, cut, fits

#: Words of a window; a fingerprint is the least hash of STRIDE successive GRAM-grams, so
#: every shared span of GRAM + STRIDE - 1 = WINDOW words holds a shared fingerprint.
WINDOW, GRAM, STRIDE = 13, 6, 8
#: Up to so many benchmark fingerprints are looked up as a set during the scan; more of them are joined.
SET_SIZE = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters (A-Z lower-cased) and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(w: str, length: int) -> Column:
    """Hash of the ``length`` words from each place of array column ``w`` on."""
    return F.when(F.size(w) >= length, F.expr(f"transform(sequence(1, size({w}) - {length - 1}), i -> xxhash64(slice({w}, i, {length})))")).otherwise(F.array().cast("array<bigint>"))


def fingerprinted(rows: DataFrame) -> DataFrame:
    """Adds the hashes ``g`` of all grams of array column ``w``, and the distinct fingerprints ``fps``."""
    out = rows.withColumn("g", grams("w", GRAM))
    step, have = 1, "g"
    while step < STRIDE:
        out = out.withColumn(f"m{step}", F.expr(f"zip_with({have}, slice({have}, {step + 1}, size({have})), (x, y) -> least(x, y))"))
        have, step = f"m{step}", step * 2
    return out.withColumn("fps", F.array_distinct(have))


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, m, win): the windows of the items' words, as text."""
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.expr(f"sequence(1, greatest(size(w) - {WINDOW - 1}, 1))")
    return items.where("size(w) > 0").select("item_id", "w", length.alias("m"), F.explode(starts).alias("i")).select("item_id", "m", F.array_join(F.expr("slice(w, i, m)"), " ").alias("win")).distinct()


def _among(texts: list[str]):
    return lambda x: x["win"].isin(texts)


def hits(docs: DataFrame, benchmark: DataFrame, set_size: int = SET_SIZE) -> tuple[DataFrame, DataFrame]:
    """(rows, found): per row doc_id, text keys k1 and k2 and n_words; per distinct text with a hit, n_hit, the item ids, and whether a window of WINDOW words is among the hits."""
    items = cut(benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")))
    windows = cut(_windows(items))
    lengths = sorted(r["m"] for r in windows.where(f"m < {WINDOW}").select("m").distinct().collect())  # 12 at most
    # an outer explode, as the inner one has its column filtered first, with all that it is computed from in place of it
    known = cut(fingerprinted(items.where(f"size(w) >= {WINDOW}")).select(F.explode_outer("fps").alias("fp")).where("fp is not null").distinct())

    rows = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), words(F.col("text")).alias("w"))
    rows = fingerprinted(rows)
    first = known.limit(set_size + 1).collect()
    if len(first) <= set_size:
        listed = ",".join(f"{r['fp']}L" for r in first)
        rows = rows.withColumn("met", F.expr(f"filter(fps, x -> x in ({listed}))") if first else F.array().cast("array<bigint>"))
    else:
        met = rows.select("k1", "k2", F.explode_outer("fps").alias("fp")).join(known, "fp", "left_semi").groupBy("k1", "k2").agg(F.collect_set("fp").alias("met"))
        rows = rows.join(met, ["k1", "k2"], "left")
    # every window that holds a gram with a met fingerprint
    places = "filter(sequence(1, size(g)), i -> array_contains(met, g[i - 1]))"
    around = f"array_distinct(flatten(transform({places}, p -> sequence(greatest(p - {STRIDE - 1}, 1), least(p, size(w) - {WINDOW - 1})))))"
    spans = F.when((F.size("met") > 0) & (F.size("w") >= WINDOW), F.expr(f"transform({around}, s -> named_struct('s', s, 'm', {WINDOW}, 'win', array_join(slice(w, s, {WINDOW}), ' ')))"))
    parts = [F.coalesce(spans, F.array().cast("array<struct<s:int,m:int,win:string>>"))]
    for m in lengths:
        short = [r["win"] for r in windows.where(F.col("m") == m).select("win").distinct().limit(set_size + 1).collect()]
        found = F.expr(f"transform(sequence(1, size(w) - {m - 1}), s -> named_struct('s', s, 'm', {m}, 'win', array_join(slice(w, s, {m}), ' ')))")
        if len(short) <= set_size:
            found = F.filter(found, _among(short))
        parts.append(F.when(F.size("w") >= m, found).otherwise(F.array().cast("array<struct<s:int,m:int,win:string>>")))
    rows = cut(rows.select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), F.concat(*parts).alias("spans")))
    spread = rows.select("k1", "k2", F.explode("spans").alias("x")).select("k1", "k2", "x.s", "x.m", "x.win")
    met = attach(spread, windows, ["m", "win"], "inner")
    found = met.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("s", "m"))).alias("at"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    n_hit = F.expr("aggregate(at, named_struct('to', 0, 'n', 0L), (a, x) -> named_struct('to', greatest(a.to, x.s + x.m), 'n', a.n + greatest(0, x.s + x.m - greatest(a.to, x.s))), a -> a.n)")
    return rows.drop("spans"), cut(found.select("k1", "k2", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), F.exists("at", lambda x: x["m"] == WINDOW).alias("full")))


def contamination(docs: DataFrame, benchmark: DataFrame, set_size: int = SET_SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) per row of ``docs``.

    A window is WINDOW successive words of an item, or all of a shorter item's. A document's words inside
    any occurrence of a window are hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words. Both sides keep the least
    gram hash of each stretch of STRIDE grams; texts that meet a benchmark fingerprint have the windows around it compared as text.

    Null or empty texts have no words; items without an id or words count for nothing, repeated item ids are one item. Rows
    with equal texts get equal results, repeated rows each; texts of any length are read whole; an empty table gives none. Other columns are ignored.
    """
    rows, found = hits(docs, benchmark, set_size)
    out = attach(rows, found, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), items.alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that give a benchmark away.

    A row goes if a whole window of WINDOW words of an item is in its text, however long the text is, or if a twentieth of its words is
    hit, by windows of any length; so an item of fewer than WINDOW words drops only texts that consist of it to that degree. Rows of
    null, empty or blank text stay. Equal texts stay or go together; an empty table or an empty benchmark drops nothing.
    """
    rows, found = hits(docs, benchmark)
    bad = cut(attach(rows, found, ["k1", "k2"], "inner").where("full or 20 * n_hit >= n_words").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct())
    keyed = docs.withColumns({"_b1": F.xxhash64("text"), "_b2": F.xxhash64(F.lit(1), "text")})
    small = F.broadcast(bad) if fits(bad) else bad
    return keyed.join(small, (F.col("_b1") == F.col("_k1")) & (F.col("_b2") == F.col("_k2")), "left_anti").select(*docs.columns)
