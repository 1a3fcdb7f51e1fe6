"""Ranking of files by what they may hold, and cuts of the ranking by a budget."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.session import durable

#: Sizes count as this at least; fixed value.
LEAST_SIZE = 4096
#: Shares of work at which recall is measured; fixed values.
BUDGETS = (0.05, 0.10, 0.20, 0.30, 0.50, 0.75)


class Budget(NamedTuple):
    kind: str  # files, bytes, time, fraction, confidence
    amount: float


def parse_budget(text: str) -> Budget:
    """``2000`` files, ``500mb`` bytes, ``30s`` time, ``20%`` of the files, ``90c`` or ``90%c`` of the expected findings; ValueError otherwise."""
    raw = text.strip().lower()
    if not raw:
        raise ValueError("a budget is missing")

    def number(value: str) -> float:
        try:
            return float(value)
        except ValueError:
            raise ValueError(f"cannot read {text!r} as an amount of files, or of s, m, h, %, c, kb, mb or gb") from None

    units = {"%c": ("confidence", 0.01), "c": ("confidence", 0.01), "%": ("fraction", 0.01), "gb": ("bytes", 1 << 30), "mb": ("bytes", 1 << 20), "kb": ("bytes", 1 << 10), "h": ("time", 3600), "m": ("time", 60), "s": ("time", 1)}
    for suffix, (kind, factor) in units.items():
        if raw.endswith(suffix):
            value = number(raw.removesuffix(suffix).rstrip("%"))
            if kind in ("confidence", "fraction") and not 0 <= value <= 100:
                raise ValueError(f"a share is 0 to 100 percent, not {value}")
            if kind == "time" and value <= 0:
                raise ValueError("time has to be more than 0")
            return Budget(kind, int(max(value, 0)) * factor if kind == "bytes" else value * factor)
    value = number(raw)
    if value < 0:
        raise ValueError("a file budget must not be negative")
    return Budget("files", int(value))


def value() -> Column:
    """Score by size: what a file's bytes are worth."""
    return F.col("score") / F.greatest(F.col("size"), F.lit(LEAST_SIZE))


def ranked(candidates: DataFrame) -> DataFrame:
    """(path, size, changed, score) rows with value and rk: changed files first, then the highest value, then by path.

    The order is global, so ranks come from range partitions and the counts ahead of each, not from one task.
    """
    rows = candidates.withColumn("value", value())
    keys = [F.desc("changed"), F.desc("value"), F.asc("path")]
    # the placing is written out: it must be the same for both uses
    placed = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    starts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # a row per partition
    ahead = starts.select(F.col("_p").alias("_q"), "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return placed.join(F.broadcast(ahead), F.col("_p") == F.col("_q")).select(*rows.columns, (F.col("_ahead") + F.col("_m") - F.col("_first") + 1).cast("long").alias("rk"))


def _before(rows: DataFrame, amount: str) -> DataFrame:
    """Adds _sum: the amount of all rows of smaller rank, by blocks of ranks (none larger than BLOCK rows)."""
    block = F.floor((F.col("rk") - 1) / BLOCK)
    rows = rows.withColumn("_b", block)
    totals = rows.groupBy("_b").agg(F.sum(amount).alias("_t"))
    ahead = totals.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_b").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_i", inside).join(ahead, F.col("_b") == F.col("_c")).withColumn("_sum", F.col("_a") + F.col("_i")).drop("_b", "_c", "_a", "_i")


#: Rows of a block of running sums.
BLOCK = 100_000


def cut(rows: DataFrame, budget: Budget) -> DataFrame:
    """The head of ranked rows that a budget pays for.

    files and fraction: so many ranks (a fraction rounded up). bytes: while the sizes so far, with the row's, fit.
    confidence: until the scores so far reach the share of all scores; if all are 0, everything. time doesn't cut.
    """
    if budget.kind == "files":
        return rows.where(F.col("rk") <= int(budget.amount))
    if budget.kind == "fraction":
        total = rows.agg(F.ceil(F.count("*") * budget.amount).alias("_n"))
        return rows.join(F.broadcast(total), F.col("rk") <= F.col("_n"), "left_semi")
    if budget.kind == "bytes":
        return _before(rows, "size").where(F.col("_sum") + F.col("size") <= int(budget.amount)).drop("_sum")
    if budget.kind == "confidence":
        total = rows.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("_all"))
        return _before(rows, "score").join(F.broadcast(total)).where((F.col("_all") <= 0) | (F.col("rk") == 1) | (F.col("_sum") < budget.amount * F.col("_all"))).drop("_sum", "_all")
    return rows


def directory_prior(samples: DataFrame) -> DataFrame:
    """(dir, hits, total, rate) by parent directory of (path, has_finding) rows; rate = (hits + 1) / (total + 2)."""
    hit = F.count_if("has_finding")
    return samples.groupBy(parent(F.col("path")).alias("dir")).agg(hit.alias("hits"), F.count("*").alias("total"), ((hit + 1) / (F.count("*") + 2)).alias("rate"))


def parent(path: Column) -> Column:
    """What comes before the last separator (also of containers); empty without one."""
    return F.regexp_extract(path, r"^(.*)[/\\!][^/\\!]*$", 1)


def prior_scores(candidates: DataFrame, prior: DataFrame, samples: DataFrame) -> DataFrame:
    """Candidates with score: the rate of their directory, or of the whole corpus for directories not seen."""
    base = samples.agg(((F.count_if("has_finding") + 1) / (F.count("*") + 2)).alias("_base"))
    rows = candidates.withColumn("dir", parent(F.col("path"))).join(prior.select("dir", "rate"), "dir", "left").join(F.broadcast(base))
    return rows.withColumn("score", F.coalesce("rate", "_base")).drop("rate", "_base", "dir")


def recall(scored: DataFrame) -> DataFrame:
    """(budget, recall, lift) of (score, path, has_finding) rows, best scores first, ties by path."""
    rows = ranked(scored.select("path", F.lit(True).alias("changed"), F.lit(LEAST_SIZE).alias("size"), "score", "has_finding"))
    total = rows.agg(F.count("*").alias("_n"))
    within = [F.count_if(F.col("rk") <= F.least(F.ceil(F.col("_n") * b), F.col("_n"))).alias(f"_h{i}") for i, b in enumerate(BUDGETS)]
    hits = rows.where("has_finding").join(F.broadcast(total)).agg(F.count("*").alias("_p"), *within)  # one row
    points = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"_h{i}").alias("hit")) for i, b in enumerate(BUDGETS)])
    found = F.when(F.col("_p") > 0, F.col("x.hit") / F.col("_p")).otherwise(0.0)
    return hits.select("_p", F.explode(points).alias("x")).select("x.budget", found.alias("recall"), (found / F.col("x.budget")).alias("lift"))


def calibration(scored: DataFrame) -> DataFrame:
    """One row, brier and ece of (score, has_finding) rows: ten bins of equal width, the last closed."""
    y = F.col("has_finding").cast("double")
    bins = scored.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(y).alias("h"), F.sum(F.pow(F.col("score") - y, 2)).alias("e"))
    return bins.agg(F.coalesce(F.sum("e") / F.sum("n"), F.lit(0.0)).alias("brier"), F.coalesce(F.sum(F.abs(F.col("s") - F.col("h"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def vocabulary(token_lists: DataFrame, cap: int = 4096) -> DataFrame:
    """(token, n, id) of the most frequent tokens of (tokens) rows; ties by token; ids from 1 (0 is for unknown ones)."""
    counts = token_lists.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(cap)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")))  # at most cap rows
