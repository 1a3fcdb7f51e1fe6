"""Language of texts by a string kernel: Nystrom landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textscan as ts

#: The spectrum blends byte n-grams of 1 to LENGTH; each hashes to one of SPACE places.
LENGTH, SPACE = 4, 8192
#: A fit takes about PER_LANG texts of each language (by hash of doc_id), SAMPLE at most in all; LANDMARKS of them span the kernel.
PER_LANG, SAMPLE, LANDMARKS, RIDGE = 500, 4000, 128, 1e-2
#: Rows of a matrix product.
ROWS = 256


class Kernel(NamedTuple):
    """score = kernel of a text with each landmark @ weights + bias."""

    langs: list[str]
    landmarks: np.ndarray  # presence, SPACE x landmarks, each scaled by 1 / sqrt of its n-grams
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, presence: np.ndarray) -> np.ndarray:
        return self.kernel(presence) @ self.weights + self.bias

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        return (presence @ self.landmarks) / np.sqrt(np.maximum(presence.sum(1), 1))[:, None]


def _letters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


def presence(column: pa.Array) -> np.ndarray:
    """Rows x SPACE: 1 where the text has an n-gram of that place. A-Z count as a-z, other ASCII as one separator."""
    data, offsets = ts._flat(column)
    codes = _letters()[data]
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size) * SPACE
    left = np.repeat(offsets[1:], size) - np.arange(len(data))
    out = np.zeros((len(size), SPACE), np.float32)
    gram = np.zeros(len(data), np.uint32)
    shift = np.uint32(32 - (SPACE.bit_length() - 1))
    for n in range(1, LENGTH + 1):
        gram = gram[: len(data) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] if n <= len(data) else gram[:0]
        place = ((gram + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift
        at = row[: len(gram)] + place
        out.reshape(-1)[at[left[: len(gram)] >= n]] = 1
    return out


def _pack(batches):
    for piece in ts.pieces(batches):
        bits = np.packbits(presence(piece.column("text")).astype(bool), axis=1)
        yield pa.RecordBatch.from_arrays([piece.column("lang"), pa.array([x.tobytes() for x in bits], pa.binary())], ["lang", "bits"])


def fit(langs: list[str], x: np.ndarray) -> Kernel:
    """One-versus-rest ridge regression in the landmarks' space; landmarks are dealt over the languages in turn."""
    names = sorted(set(langs))
    of = np.array([names.index(a) for a in langs])
    turn = np.zeros(len(of), int)
    for k in range(len(names)):
        turn[of == k] = np.arange((of == k).sum())
    chosen = np.lexsort((of, turn))[:LANDMARKS]
    marks = (x[chosen] / np.sqrt(np.maximum(x[chosen].sum(1), 1))[:, None]).T.astype(np.float32)
    model = Kernel(names, np.ascontiguousarray(marks), np.zeros((len(chosen), len(names)), np.float32), np.zeros(len(names), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(x[chosen]).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = model.kernel(x).astype(float) @ root
    y = (of[:, None] == np.arange(len(names))[None, :]).astype(float)
    share = 1 / np.bincount(of, minlength=len(names))[of]
    mean, goal = np.average(phi, 0, share), np.average(y, 0, share)
    a = (phi - mean) * share[:, None]
    solved = np.linalg.solve(a.T @ (phi - mean) + RIDGE * np.eye(phi.shape[1]), a.T @ (y - goal))
    return Kernel(names, model.landmarks, (root @ solved).astype(np.float32), (goal - mean @ solved).astype(np.float32))


def fit_from(docs: DataFrame, trainable: Column) -> Kernel | None:
    """The model of a bounded sample of the rows that ``trainable`` allows; None if there are none."""
    known = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(2, min(PER_LANG, SAMPLE // len(counts)))
    part = F.create_map(*[F.lit(v) for k in sorted(counts) for v in (k, min(1.0, each / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    found = known.where(draw < part[F.col("lang")]).select("lang", "text").mapInArrow(_pack, "lang string, bits binary").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("lang", "ascending"), ("bits", "ascending")])
    bits = np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8).reshape(-1, SPACE // 8)
    return fit(found.column("lang").to_pylist(), np.unpackbits(bits, axis=1).astype(np.float32))


def _predict(model: Kernel | None):
    def scan(batches):
        for piece in ts.pieces(batches):
            n = len(piece)
            has = piece.column("has_letter").to_numpy(zero_copy_only=False)
            best, value = np.zeros(n, int), np.zeros(n)
            if model is not None:
                for at in range(0, n, ROWS):
                    s = model.scores(presence(piece.column("text").slice(at, ROWS)))
                    best[at : at + ROWS], value[at : at + ROWS] = s.argmax(1), np.clip(s.max(1), 0, 1)
            names = [model.langs[b] if model is not None and ok else "und" for b, ok in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(names), pa.array(np.where(has, value, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return scan


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``.

    held_out: crc32 of doc_id as text modulo 4 is 2 (a null doc_id: false); such rows are not learned from.
    lang_pred: the language whose regression is highest, ``und`` (score 0) where the text is null or has
    no letter, or nothing could be learned. score: that regression, held in 0 to 1. Only the text
    predicts; texts of any length are read whole. Ties go to the first language by name. Repeated rows are judged each;
    an empty table gives none.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"))
    model = fit_from(rows, ~F.col("held_out"))
    scored = rows.select("doc_id", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), "text")
    return scored.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
