"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes other than space and TAB..CR; UTF-8 never uses
those bytes inside a character, so bytes and characters agree. Hashes of short
ranges are polynomials over random values modulo 2**64, taken from prefix sums, then
mixed; a second lane with other constants makes 128-bit keys. Such polynomials
agree on some sequences of 1,024 values and more (the Thue-Morse sequence and its
complement), in every lane, so ranges of over SHORT values are hashed by BLAKE2 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
#: Most values of a range that a polynomial is used for.
SHORT = 512
U64 = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters only (ASCII letters and all other characters beyond ASCII).
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words(NamedTuple):
    """Words of a piece: byte ranges, the row of each word, and the first word of each row (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (a row at least)."""
    for batch in batches:
        sizes = np.diff(_flat(batch.column(column))[1])
        at = 0
        total = np.concatenate([[0], np.cumsum(sizes)])
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto
    pa.default_memory_pool().release_unused()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, kind: np.ndarray = _IS_WORD) -> Words:
    """The words of every row, runs of bytes of ``kind``; a null row has none."""
    data, offsets = _flat(column)
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][filled] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, row, np.searchsorted(start, offsets))


@lru_cache(8)
def _bytes_of(lane: int, lower: bool) -> np.ndarray:
    table = np.random.default_rng(1000 + lane).integers(0, 2**64, 256, U64)
    if lower:
        table[65:91] = table[97:123]
    return table


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(lane: int, inverse: bool, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, for the lane's odd base or its inverse."""
    have = _powers.get((lane, inverse))
    if have is None or len(have) < n:
        base = int(np.random.default_rng(2000 + lane).integers(0, 2**62)) * 4 + 3
        base = pow(base, -1, 2**64) if inverse else base
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = _powers[lane, inverse] = np.cumprod(steps, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Hash of values[start:end] for each pair; for ranges of SHORT values at most."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power(lane, False, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * _power(lane, True, len(values) + 1)[start] + (end - start).astype(U64))


def word_hashes(found: Words, lane: int = 0, lower: bool = False) -> np.ndarray:
    """A hash of each word; with ``lower``, A-Z count as a-z."""
    out = ranges(_bytes_of(lane, lower)[found.data], found.start, found.end, lane)
    for i in np.flatnonzero(found.end - found.start > SHORT):
        word = found.data[found.start[i] : found.end[i]].tobytes()
        out[i] = np.frombuffer(hashlib.blake2b(word.lower() if lower else word, digest_size=8, salt=bytes([lane])).digest(), U64)[0]
    return out


def digests(lanes: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two halves, of the values first[i]:first[i+1] of each row in all lanes, whatever their number."""
    out = np.zeros((len(first) - 1, 2), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        whole = hashlib.blake2b(digest_size=16)
        for lane in lanes:
            whole.update(lane[a:b].tobytes())
        out[i] = np.frombuffer(whole.digest(), np.int64)
    return out[:, 0], out[:, 1]


def long_list(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """list<int64> rows values[first[i]:first[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64)))
