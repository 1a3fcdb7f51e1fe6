"""Two chains, of paths with and without findings: scores by their odds, calibrated on held-out paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import paths
from siftstone.model import chain as hmm
from siftstone.operators import ranking

#: States, tokens of the vocabulary; rounds of a fit and of the fit for calibration. Fixed values.
STATES, VOCABULARY, ROUNDS, QUICK = 8, 4096, 30, 10
#: Distinct sequences that are fitted on the driver; more are summed on the executors.
LOCAL = 50_000
#: Second chain's salt; fixed value.
OTHER = 7919


class PathModel:
    """score(path) = logistic(slope * odds + intercept), odds from both chains and the prior."""

    def __init__(self, tokens: dict[str, int], positive: hmm.Chain, negative: hmm.Chain, prior: float, samples: int, slope: float = 1.0, intercept: float = 0.0) -> None:
        self.tokens, self.positive, self.negative, self.prior, self.samples, self.slope, self.intercept = tokens, positive, negative, prior, samples, slope, intercept

    def encode(self, tokens: list[str]) -> list[int]:
        return [self.tokens.get(t, 0) for t in tokens]

    def odds(self, sequences: list[list[int]]) -> np.ndarray:
        prior = np.log(self.prior / (1 - self.prior))
        return hmm.log_likelihood(self.positive, sequences) - hmm.log_likelihood(self.negative, sequences) + prior

    def scores(self, sequences: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.odds(sequences) + self.intercept, -700, 700)))

    def explain(self, tokens: list[str]) -> list[tuple[str, float]]:
        """What each token adds to the odds of the path so far."""
        encoded = self.encode(tokens)
        odds = self.odds([encoded[: i + 1] for i in range(len(encoded))])
        before = np.concatenate([[np.log(self.prior / (1 - self.prior))], odds[:-1]])
        return list(zip(tokens, (odds - before).tolist(), strict=True))

    def to_json(self) -> str:
        dump = lambda c: [c.init.tolist(), c.trans.tolist(), c.emit.tolist()]
        return json.dumps({"kind": "chains", "tokens": self.tokens, "positive": dump(self.positive), "negative": dump(self.negative), "prior": self.prior, "samples": self.samples, "slope": self.slope, "intercept": self.intercept})

    @classmethod
    def from_json(cls, text: str) -> PathModel:
        value = json.loads(text)
        load = lambda parts: hmm.Chain(*map(np.array, parts))
        return cls(value["tokens"], load(value["positive"]), load(value["negative"]), value["prior"], value["samples"], value["slope"], value["intercept"])


def _sequences(samples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(ids, has_finding, n): distinct token sequences with how often each occurs. The vocabulary is bounded."""
    table = {r["token"]: r["id"] for r in vocabulary.collect()}
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else None
    encode = (lambda t: F.coalesce(F.try_element_at(lookup, t), F.lit(0))) if table else (lambda t: F.lit(0))
    return samples.select(F.transform(paths.tokens(F.col("path")), encode).alias("ids"), "has_finding").where(F.size("ids") > 0).groupBy("ids", "has_finding").agg(F.count("*").alias("n"))


def _expected(rows: DataFrame, size: int):
    """The counts of all sequences for a chain: on the driver if there are few, else as sums of the partitions."""
    if rows.limit(LOCAL + 1).count() <= LOCAL:
        local = rows.orderBy("ids").collect()
        ids, weights = [r["ids"] for r in local], np.array([r["n"] for r in local], float)
        return lambda c: hmm.expect(c, ids, weights)

    def distributed(c: hmm.Chain) -> hmm.Counts:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                part = hmm.expect(c, [list(x) for x in batch["ids"]], batch["n"].to_numpy())
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"counts": [np.concatenate([np.ravel(x) for x in total])]})

        out = None
        for row in rows.select("ids", "n").mapInPandas(scan, "counts array<double>").collect():  # a row per partition
            flat, s = np.array(row["counts"]), len(c.init)
            part = hmm.Counts(flat[:s], flat[s : s + s * s].reshape(s, s), flat[s + s * s : -2].reshape(s, size), flat[-2], flat[-1])
            out = part if out is None else out + part
        return out

    return distributed


def _fit_chains(samples: DataFrame, states: int, rounds: int, cap: int) -> PathModel:
    vocabulary = ranking.vocabulary(samples.select(paths.tokens(F.col("path")).alias("tokens")), cap)
    tokens = {r["token"]: r["id"] for r in vocabulary.collect()}  # at most cap
    rows = _sequences(samples, vocabulary).persist()
    counts = {r["has_finding"]: r["n"] for r in rows.groupBy("has_finding").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    prior = min(max(counts.get(True, 0) / total, hmm.FLOOR), 1 - hmm.FLOOR) if total else 0.5
    chains = [hmm.fit(_expected(rows.where(F.col("has_finding") == label), len(tokens) + 1), states, len(tokens) + 1, salt, rounds) for label, salt in ((True, 0), (False, OTHER))]
    rows.unpersist()
    return PathModel(tokens, *chains, prior, total)


def platt(odds: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic map of odds to labels, each counted so often; (1, 0) for too few labels or a slope that isn't positive."""
    counts = np.ones(len(odds)) if counts is None else counts.astype(float)
    positive, negative = int(counts[labels].sum()), int(counts[~labels].sum())
    if positive < 2 or negative < 2:
        return 1.0, 0.0
    goal = np.where(labels, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = max(1.0, float(np.abs(odds).max()))
    x, a, b = odds / scale, 1.0, 0.0
    for _ in range(2000):
        err = 1 / (1 + np.exp(-np.clip(a * x + b, -700, 700))) - goal
        a, b = a - 0.5 * float(np.average(err * x, weights=counts)), b - 0.5 * float(np.average(err, weights=counts))
    a /= scale
    return (a, b) if np.isfinite(a) and np.isfinite(b) and a > 0 else (1.0, 0.0)


#: Decimals of the odds that held-out paths are counted by for the calibration.
DECIMALS = 2


def train(samples: DataFrame, states: int = STATES, rounds: int = ROUNDS, cap: int = VOCABULARY) -> PathModel:
    """The model of (path, has_finding) rows; ValueError if all have one label.

    Chains are fitted on everything; the calibration on a quarter of the paths, scored by a model that didn't see them.
    """
    labels = {r["has_finding"] for r in samples.select("has_finding").distinct().collect()}
    if labels != {True, False}:
        raise ValueError("training needs paths with and without findings")
    model = _fit_chains(samples, states, rounds, cap)

    held = F.pandas_udf(lambda p: pd.Series((paths.fnv1a(p) >> np.uint64(13)) % np.uint64(4) == 0), "boolean")
    split = samples.withColumn("_held", held("path"))
    seen, kept = split.where("not _held"), split.where("_held")
    n = {r["has_finding"]: r["count"] for r in seen.groupBy("has_finding").count().collect()}
    if min(n.get(True, 0), n.get(False, 0)) >= 2 and kept.limit(8).count() == 8:
        quick = _fit_chains(seen, states, min(rounds, QUICK), cap)
        odds = F.pandas_udf(lambda lists: pd.Series(quick.odds([quick.encode(list(t)) for t in lists])), "double")
        rated = kept.select(paths.tokens(F.col("path")).alias("t"), "has_finding").where(F.size("t") > 0).select(F.round(odds("t"), DECIMALS).alias("odds"), "has_finding")
        bins = rated.groupBy("odds", "has_finding").count().orderBy("odds", "has_finding").collect()  # a row per hundredth of the odds
        model.slope, model.intercept = platt(np.array([r["odds"] for r in bins]), np.array([r["has_finding"] for r in bins], bool), np.array([r["count"] for r in bins]))
    return model


def score(candidates: DataFrame, model: PathModel) -> DataFrame:
    """Candidates with their score."""

    def each(token_lists: pd.Series) -> pd.Series:
        return pd.Series(model.scores([model.encode(list(t)) for t in token_lists]))

    return candidates.withColumn("score", F.pandas_udf(each, "double")(paths.tokens(F.col("path"))))


def evaluate(samples: DataFrame, holdout: float = 0.3, **options) -> dict | None:
    """Recall of the model and of the directory prior at each budget, and calibration, on held-out paths; None if a side has no use."""
    share = min(max(holdout, 0.05), 0.95)
    split = samples.withColumn("_held", paths.held_out(share)("path")).persist()
    test, seen = split.where("_held").drop("_held"), split.where("not _held").drop("_held")
    n_test, n_seen = test.count(), seen.count()
    hit_test, hit_seen = test.where("has_finding").count(), seen.where("has_finding").count()
    if not hit_test or not hit_seen or hit_seen == n_seen or n_test < 2:
        return None
    model = train(seen, **options)
    scored = score(test, model).persist()
    prior = ranking.prior_scores(test, ranking.directory_prior(seen), seen)
    by_model = {r["budget"]: r["recall"] for r in ranking.recall(scored).collect()}
    by_prior = {r["budget"]: r["recall"] for r in ranking.recall(prior).collect()}
    quality = ranking.calibration(scored).first()
    points = [{"budget": b, "model": by_model[b], "baseline": by_prior[b], "random": b, "lift": by_model[b] / b} for b in ranking.BUDGETS]
    return {"train": n_seen, "test": n_test, "test_positives": hit_test, "points": points, "mean_lift": sum(p["lift"] for p in points) / len(points), "brier": quality["brier"], "ece": quality["ece"], "calibrated": quality["ece"] <= 0.15}
