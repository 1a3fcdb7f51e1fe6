"""Removal of passages that repeat across documents, by difference-cover anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textscan as ts
from siftstone.llm.shared import attach, cut

#: A perfect difference cover; every shift modulo 31 is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words of a window.
WINDOW = 50


def _anchors(window: int):
    """A digest of the words of each row, and its anchors."""
    length = window - PERIOD + 1
    on_cover = np.isin(np.arange(PERIOD), COVER)

    def scan(batches):
        for piece in ts.pieces(batches):
            w = ts.words(piece.column("text"))
            hashes = [ts.word_hashes(w, k) for k in (0, 1)]
            cols = map(pa.array, ts.digests(hashes, w.first))
            place = np.arange(len(w.start)) - w.first[w.row]
            at = np.flatnonzero(on_cover[place % PERIOD] & (place + length <= w.counts[w.row]) & (w.counts[w.row] >= window))
            found = ts.ranges(hashes[0], at, at + length, 4)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), *cols, pa.array(w.counts), ts.long_list(found, np.searchsorted(at, w.first))], ["doc_id", "text_key", "d1", "d2", "n_words", "anchors"])

    return scan


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some [lo, hi)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.clip(lo, 0, n), 1)
    np.add.at(steps, np.clip(hi, 0, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _windows(window: int):
    """Rows of every window that starts in one of the row's spans: 128-bit key and place."""

    def scan(batches):
        for piece in ts.pieces(batches):
            w = ts.words(piece.column("text"))
            at = []
            for i, (lo, hi) in enumerate(zip(piece.column("lo").to_pylist(), piece.column("hi").to_pylist(), strict=True)):
                n = int(w.counts[i]) - window + 1
                if n > 0 and lo:
                    at.append(w.first[i] + np.flatnonzero(_covered(np.array(lo), np.array(hi) + 1, n)))
            at = np.concatenate(at) if at else np.empty(0, np.int64)
            keys = [ts.ranges(ts.word_hashes(w, k), at, at + window, 6 + k).view(np.int64) for k in (0, 1)]
            row = w.row[at] if len(at) else at
            ids = [piece.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")]
            place = (at - w.first[row]).astype(np.int32) if len(at) else at.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, keys), pa.array(place)], ["doc_id", "text_key", "w1", "w2", "place"])

    return scan


def _removal(window: int):
    def apply(batches):
        for piece in ts.pieces(batches):
            w = ts.words(piece.column("text"))
            raw = w.data.tobytes()
            gone, digests, texts = [], [], []
            for i, (copy, lo, hi) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("copy", "lo", "hi")), strict=True)):
                n = int(w.counts[i])
                drop = np.zeros(n, bool)
                if copy and n >= window:
                    drop[:] = True
                elif lo:
                    drop = _covered(np.array(lo), np.array(hi) + window, n)
                keep = w.first[i] + np.flatnonzero(~drop)
                text = b" ".join([raw[a:b] for a, b in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                gone.append(int(drop.sum()))
                texts.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(w.counts), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return apply


def _spans(places: Column, reach: int) -> tuple[Column, Column]:
    """First and last places of the runs in sorted ``places`` whose steps are at most ``reach``."""
    lo = F.filter(places, lambda x, i: (i == 0) | (x - F.get(places, i - 1) > reach))
    hi = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) - x > reach))
    return lo, hi


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): documents without the words of repeated windows.

    A window of ``window`` consecutive words (over 31, 512 at most) is repeated if its word sequence
    also starts in a document with a smaller doc_id. Anchors of ``window - 30`` words are
    hashed only at places that lie in a difference cover modulo 31; two equal windows
    anywhere share such an anchor at one offset. Anchors of two documents or more are
    extended to every window around them, and these are compared by 128-bit keys.

    One row per input row. Null text: no words. A null doc_id: its text stays whole and
    removes nothing. Rows with one doc_id never remove each other's words. Documents with
    the same word sequence count once in the search; all but the smallest lose all words
    (if they have a window). Texts of any length are read whole. An empty table gives none. Other columns are ignored.
    """
    if not PERIOD < window <= ts.SHORT:
        raise ValueError(f"window must be within {PERIOD + 1} and {ts.SHORT}")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    known = keyed.where("doc_id is not null")
    scanned = cut(known.mapInArrow(_anchors(window), "doc_id long, text_key long, d1 long, d2 long, n_words long, anchors array<long>"))
    digests = scanned.drop("anchors")
    # written out like ``shared`` below, so that the rows of one sequence of words can be split over tasks
    classes = cut(digests.where(F.col("n_words") >= window).groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    copies = digests.join(classes, ["d1", "d2", "n_words"]).where("doc_id > least").select("doc_id", "text_key").distinct()

    firsts = scanned.where(F.size("anchors") > 0).groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("doc_id"), F.any_value("anchors").alias("anchors"))
    anchors = firsts.select("doc_id", F.posexplode("anchors").alias("nth", "anchor"))
    # written out, so that the join deals both sides anew and can split the rows of one key over tasks
    shared = cut(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    cover, size = F.array(*map(F.lit, sorted(COVER))), len(COVER)
    place = F.floor(F.col("nth") / size).cast("int") * PERIOD + F.get(cover, F.col("nth") % size)
    hits = anchors.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set(place)).alias("places"))
    # a window holds an anchor at `a` if it starts in [a - 30, a]
    lo, hi = _spans(F.col("places"), PERIOD)
    around = cut(hits.select("doc_id", F.transform(lo, lambda x: x - (PERIOD - 1)).alias("lo"), hi.alias("hi")))

    rows = attach(known, around, ["doc_id"], "inner")
    windows = rows.select("doc_id", "text_key", "text", "lo", "hi").mapInArrow(_windows(window), "doc_id long, text_key long, w1 long, w2 long, place int")
    least = cut(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1", "w2", "least"))
    repeats = windows.join(least, ["w1", "w2"]).where("doc_id > least").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("place")).alias("places"))
    lo, hi = _spans(F.col("places"), window)
    spans = repeats.select("doc_id", "text_key", lo.alias("lo"), hi.alias("hi"))
    none = F.lit(None).cast("array<int>")
    marks = spans.join(copies, ["doc_id", "text_key"], "left_anti").withColumn("copy", F.lit(False))
    marks = cut(marks.union(copies.select("doc_id", "text_key", none, none, F.lit(True))))
    rows = attach(keyed, marks, ["doc_id", "text_key"], "left")
    return rows.select("doc_id", "text", "copy", "lo", "hi").mapInArrow(_removal(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
