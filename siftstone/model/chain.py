"""Hidden Markov chains over token ids, fitted by expectation and maximisation on batches of padded sequences."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Least value of a probability under a logarithm, and smoothing of counts.
FLOOR, SMOOTH = 1e-12, 1e-3


class Chain(NamedTuple):
    init: np.ndarray  # states
    trans: np.ndarray  # states x states
    emit: np.ndarray  # states x vocabulary


class Counts(NamedTuple):
    """Expected counts of a batch; batches add up."""

    init: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    log_likelihood: float
    weight: float

    def __add__(self, other: Counts) -> Counts:
        return Counts(*(a + b for a, b in zip(self, other, strict=True)))


def tilted(rows: int, columns: int, salt: int) -> np.ndarray:
    """Fixed, faintly uneven rows of probabilities, so that states differ from the start."""
    at = np.arange(columns, dtype=np.uint64)[None, :] * np.uint64(2_654_435_761) ^ (np.arange(rows, dtype=np.uint64)[:, None] + np.uint64(salt)) * np.uint64(40_503)
    out = 1 + (at % np.uint64(1000)) / 1000.0
    return out / out.sum(1, keepdims=True)


def start(states: int, vocabulary: int, salt: int = 0) -> Chain:
    return Chain(tilted(1, states, salt)[0], tilted(states, states, salt + 1), tilted(states, vocabulary, salt + 101))


def pad(sequences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids as a rectangle, and lengths."""
    lengths = np.array([len(s) for s in sequences], int)
    out = np.zeros((len(sequences), max(1, lengths.max(initial=0))), int)
    for row, s in zip(out, sequences, strict=True):
        row[: len(s)] = s
    return out, lengths


def _forward(chain: Chain, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward values, scales and log likelihoods; beyond a sequence's end the last values stay."""
    n, steps = ids.shape
    alpha, scale = np.zeros((steps, n, len(chain.init))), np.ones((steps, n))
    now = chain.init * chain.emit[:, ids[:, 0]].T
    for t in range(steps):
        if t:
            now = (alpha[t - 1] @ chain.trans) * chain.emit[:, ids[:, t]].T
        total = now.sum(1)
        empty = total <= 0
        scale[t] = np.where(empty, 1, total)
        alpha[t] = np.where(empty[:, None], 1 / len(chain.init), now / scale[t][:, None])
        past = t >= lengths
        scale[t, past] = 1
        if t:
            alpha[t, past] = alpha[t - 1, past]
    return alpha, scale, np.log(np.maximum(scale, FLOOR)).sum(0)


def log_likelihood(chain: Chain, sequences: list[list[int]]) -> np.ndarray:
    if not sequences:
        return np.zeros(0)
    ids, lengths = pad(sequences)
    return np.where(lengths > 0, _forward(chain, ids, lengths)[2], 0.0)


def expect(chain: Chain, sequences: list[list[int]], weights: np.ndarray) -> Counts:
    """Expected counts of sequences, each counted ``weights`` times. Empty sequences count for nothing."""
    chosen = [i for i, s in enumerate(sequences) if s]
    states, vocabulary = chain.emit.shape
    init, trans, emit = np.zeros(states), np.zeros((states, states)), np.zeros((vocabulary, states))
    if not chosen:
        return Counts(init, trans, emit.T, 0.0, 0.0)
    ids, lengths = pad([sequences[i] for i in chosen])
    w = np.asarray(weights, float)[chosen]
    alpha, scale, ll = _forward(chain, ids, lengths)
    beta = np.ones_like(alpha[0])
    for t in range(ids.shape[1] - 1, -1, -1):
        if t + 1 < ids.shape[1]:
            ahead = chain.emit[:, ids[:, t + 1]].T * beta / scale[t + 1][:, None]
            inside = (t + 1 < lengths)[:, None]
            trans += chain.trans * ((alpha[t] * w[:, None] * inside).T @ ahead)
            beta = np.where(inside, ahead @ chain.trans.T, 1.0)
        gamma = alpha[t] * beta
        gamma = gamma / np.maximum(gamma.sum(1, keepdims=True), FLOOR) * (w * (t < lengths))[:, None]
        np.add.at(emit, ids[:, t], gamma)
        if t == 0:
            init += gamma.sum(0)
    return Counts(init, trans, emit.T, float((ll * w).sum()), float(w.sum()))


def maximise(counts: Counts) -> Chain:
    norm = lambda x: (x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True)
    return Chain(norm(counts.init), norm(counts.trans), norm(counts.emit))


def fit(expected, states: int, vocabulary: int, salt: int = 0, rounds: int = 30, tolerance: float = 1e-4) -> Chain:
    """``expected(chain)`` gives the counts of all sequences: computed here, or on the executors."""
    chain, before = start(states, vocabulary, salt), -np.inf
    for _ in range(rounds):
        counts = expected(chain)
        if not counts.weight:
            break
        chain = maximise(counts)
        mean = counts.log_likelihood / counts.weight
        if abs(mean - before) < tolerance:
            break
        before = mean
    return chain


def best_path(chain: Chain, sequence: list[int]) -> list[int]:
    """The likeliest states of a sequence."""
    if not sequence:
        return []
    log = lambda x: np.log(np.maximum(x, FLOOR))
    score, back = log(chain.init) + log(chain.emit[:, sequence[0]]), []
    for token in sequence[1:]:
        each = score[:, None] + log(chain.trans)
        back.append(each.argmax(0))
        score = each.max(0) + log(chain.emit[:, token])
    out = [int(score.argmax())]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return out[::-1]
