"""Quality grades of texts by ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textscan as ts

#: Bits of the feature space; labelled rows that a fit takes at most (the first by hash of doc_id).
BITS, FIT_ROWS = 18, 8000
#: Grades: 0 toxic, 1 poor, 2 good. Kept: the chance of more than 1 is at least KEEP.
GRADES, KEEP = 3, 0.5
#: Fit: penalty on squared weights, rounds and step of the optimiser.
PENALTY, ROUNDS, STEP = 5e-4, 200, 0.3
#: A feature counts if so many labelled rows have it and a score test of it alone is so many deviations off.
LEAST_ROWS, LEAST_Z = 8, 5.0


class Ordinal(NamedTuple):
    """P(grade > k) = 1 / (1 + exp(cuts[k] - weights of a text's features)); the cuts ascend."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) of each of n rows, k = 0 .. grades - 2."""
        score = np.bincount(rows, self.weights[ids], n)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) pairs without repeats, and word counts: each distinct word of letters (A-Z lower-cased),
    and in steps of a power of two the share of words by form (capitals, symbols, digits, length)
    and of words seen earlier in the text. Whole texts are read."""
    w = ts.words(column)
    n, counts = len(column), w.counts
    plain = ts.words(column, ts.LETTERS)
    hashes = ts.word_hashes(plain, 0, lower=True)
    shift = np.uint64(64 - bits)
    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[[ord(c) for c in "#*$%&|<>{}=!"]], kinds[48:58] = 1, 2, 3
    of = kinds[w.data]
    length = w.end - w.start

    def inside(kind: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of == kind)])
        return sums[w.end] - sums[w.start]

    capitals, symbols, digits = inside(1), inside(2), inside(3)
    form = (2 * capitals > length) * 1 + (symbols > 0) * 2 + (digits > 0) * 4 + (length > 20) * 8
    pairs = np.unique((plain.row.astype(np.uint64) << np.uint64(bits)) | (hashes >> shift))
    rows, ids = (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)
    shares = np.zeros((n, 18))
    np.add.at(shares, (w.row, form), 1)
    shares[:, 16] = np.maximum(plain.counts - np.bincount(rows, minlength=n), 0)
    shares[:, 17] = 1
    shares /= np.maximum(counts, 1)[:, None]
    level = np.where(shares > 0, np.clip(np.floor(np.log2(np.maximum(shares, 1e-9))) + 12, 0, 12), 13).astype(np.uint64)
    extra = ts.mix(level + (np.arange(18, dtype=np.uint64) + np.uint64(1)) * np.uint64(1000)) >> shift
    rows = np.concatenate([rows, np.repeat(np.arange(n), 18)])
    return rows, np.concatenate([ids, extra.ravel().astype(np.int64)]), counts


def _extract(bits: int):
    def scan(batches):
        for piece in ts.pieces(batches):
            rows, ids, _ = features(piece.column("text"), bits)
            order = np.argsort(rows, kind="stable")
            yield pa.RecordBatch.from_arrays([piece.column("grade"), ts.long_list(ids[order], np.searchsorted(rows[order], np.arange(len(piece) + 1)))], ["grade", "ids"])

    return scan


def _slopes(model: Ordinal, grades: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the log likelihood: by each row's score, and by each cut."""
    n = len(grades)
    p = model.tails(rows, ids, n)
    # the chance of a grade is the difference of neighbouring tails
    upper = np.concatenate([np.ones((n, 1)), p], 1)[np.arange(n), grades]
    lower = np.concatenate([p, np.zeros((n, 1))], 1)[np.arange(n), grades]
    chance = np.maximum(upper - lower, 1e-9)
    steep = p * (1 - p) / chance[:, None]
    cuts = np.array([steep[grades == k, k].sum() - steep[grades == k + 1, k].sum() for k in range(p.shape[1])])
    return (upper * (1 - upper) - lower * (1 - lower)) / chance, cuts


def fit(grades: np.ndarray, rows: np.ndarray, ids: np.ndarray, n_grades: int = GRADES, bits: int = BITS) -> Ordinal:
    """Maximum penalised likelihood by full-batch adaptive gradient steps; the same input gives the same model."""
    n = len(grades)
    weights, seen = np.zeros(1 << bits), np.bincount(ids, minlength=1 << bits)
    share = np.array([(np.sum(grades > k) + 1) / (n + 2) for k in range(n_grades - 1)])
    cuts = np.log((1 - share) / share)
    # score test of each feature alone, at weights of 0
    slope, _ = _slopes(Ordinal(weights, cuts), grades, rows, ids)
    spread = np.sqrt(np.maximum(np.var(slope) * seen * (1 - seen / n), 1e-12))
    useful = (seen >= LEAST_ROWS) & (np.abs(np.bincount(ids, slope[rows] - slope.mean(), 1 << bits)) >= LEAST_Z * spread)
    rows, ids = rows[useful[ids]], ids[useful[ids]]
    square, square_cut = np.full(1 << bits, 1e-8), np.full(n_grades - 1, 1e-8)
    for _ in range(ROUNDS):
        slope, cut_slope = _slopes(Ordinal(weights, cuts), grades, rows, ids)
        down, cut_down = np.bincount(ids, slope[rows], 1 << bits) / n - PENALTY * weights, cut_slope / n
        square += down**2
        square_cut += cut_down**2
        weights = weights + STEP * down / np.sqrt(square)
        cuts = np.maximum.accumulate(cuts + STEP * cut_down / np.sqrt(square_cut))
    return Ordinal(weights.astype(np.float32).astype(float), cuts)


def grade_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels with quality and toxic: 0 if toxic, else 1 plus quality; unknown labels are left out, of several the lowest counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") >= 1, 2).when(F.col("quality") == 0, 1)
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_from(docs: DataFrame, grades: DataFrame, limit: int = FIT_ROWS) -> Ordinal | None:
    """The model of at most ``limit`` graded documents, the first by hash of doc_id; None without any."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")
    found = rows.mapInArrow(_extract(BITS), "grade int, ids array<long>").toArrow()
    if not found.num_rows:
        return None
    lists = found.column("ids").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    return fit(found.column("grade").to_numpy().astype(int), np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy())


def _score(model: Ordinal | None, keep: float):
    def scan(batches):
        for piece in ts.pieces(batches):
            rows, ids, counts = features(piece.column("text"))
            if model is None:
                n = len(piece)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts), *[pa.nulls(n, pa.float64())] * 3, pa.array(np.ones(n, bool))], _OUT)
                continue
            p = model.tails(rows, ids, len(piece))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p[:, -1] >= keep)], _OUT)

    return scan


_OUT = ["doc_id", "n_words", "expected_grade", "above_lowest", "tail_probability", "kept"]


def score(docs: DataFrame, model: Ordinal | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, expected_grade, above_lowest, tail_probability, kept) per row of ``docs``.

    expected_grade is the sum of the tails P(grade > k); above_lowest is P(grade > 0);
    tail_probability is that of the best grade; kept if it is at least ``keep``, so also if it is just that. A null or empty text is
    scored by its lack of words. Repeated rows are scored each; texts of any length are read whole; an empty table gives none.
    Without a model (no labels) all is kept and scores are null. Other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_score(model, keep), "doc_id long, n_words long, expected_grade double, above_lowest double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: Ordinal | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept."""

    def scan(batches):
        for piece in ts.pieces(batches):
            if model is None:
                yield piece
                continue
            rows, ids, _ = features(piece.column("text"))
            yield piece.filter(pa.array(model.tails(rows, ids, len(piece))[:, -1] >= keep))

    return docs.mapInArrow(scan, docs.schema)
