"""Quality rules at the level of hosts: failure rates shrunk by an empirical beta prior. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.shared import cut, fits

#: Windows for repeated words, least words, and most repeated words in hundredths.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Beside the rules above, a document fails for its host with more symbols a word (hundredths), or more repeated lines (hundredths of its lines).
MOST_SYMBOLS, MOST_DUP_LINES = 10, 30
#: A host is refused if its rate of failures is surely over TIMES the mean of all hosts, held within LIMITS; surely: by SURE
#: deviations of its posterior (95 %).
TIMES, LIMITS, SURE = 2.0, (0.2, 0.6), 1.645
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1000.0)

_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def _without(text: str, signs: str) -> Column:
    return F.translate(text, signs, "")


def rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and failed (that or another rule) of each row."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("w", F.array_remove(F.split("text", _BLANK), ""))
    rows = rows.withColumn("lines", F.when(F.instr("text", "\n") > 0, F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)))
    # a hash of each word, then of two, four and five successive ones
    rows = rows.withColumn("h1", F.when(F.size("w") > WINDOW, F.expr("transform(w, x -> xxhash64(x))")))
    rows = rows.withColumn("h2", F.expr("zip_with(h1, slice(h1, 2, size(h1)), (x, y) -> xxhash64(x, y))"))
    rows = rows.withColumn("h4", F.expr("zip_with(h2, slice(h2, 3, size(h1)), (x, y) -> xxhash64(x, y))"))
    rows = rows.withColumn("grams", F.expr(f"zip_with(slice(h4, 1, size(h1) - {WINDOW - 1}), slice(h1, {WINDOW}, size(h1)), (x, y) -> xxhash64(x, y))"))
    # places of each repeated window: sorted by hash, a neighbour is alike
    rows = rows.withColumn("pairs", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.expr("transform(grams, (h, i) -> named_struct('h', h, 'i', i))"))))
    alike = "(i > 0 and get(pairs, i - 1).h = x.h) or (i < size(pairs) - 1 and get(pairs, i + 1).h = x.h)"
    rows = rows.withColumn("places", F.expr(f"array_sort(transform(filter(pairs, (x, i) -> {alike}), x -> x.i))"))
    covered = F.expr(f"aggregate(places, named_struct('to', 0, 'n', 0L), (a, x) -> named_struct('to', x + {WINDOW}, 'n', a.n + x + {WINDOW} - greatest(a.to, x)), a -> a.n)")
    out = rows.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(_without("text", _BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without("text", "#*$%&|<>"))).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce(F.size("lines"), F.lit(1)).alias("_lines"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    marks = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("_lines"))
    return out.withColumn("failed", F.col("base_failed") | marks).drop("_lines")


def hosts(checked: DataFrame) -> DataFrame:
    """(source, n, fails, rate, refused) per host of rows with source and failed.

    rate = (fails + a) / (n + a + b). The prior's a and b fit the hosts' rates by moments, each host counting once: their mean m, and
    their variance less what chance adds to it (m * (1 - m) / n on a host of n documents), v, give
    a + b = m * (1 - m) / v - 1, held within STRENGTH; without variance it is the upper bound. A host is refused if rate lies SURE posterior
    deviations (a normal in the beta's place) over the limit, so few documents alone refuse no host. A rate just there doesn't refuse.
    """
    counts = cut(checked.groupBy("source").agg(F.count("*").alias("n"), F.count_if("failed").alias("fails")))
    share = F.col("fails") / F.col("n")
    m, spread, chance = counts.agg(F.avg(share), F.var_samp(share), F.avg(1 / F.col("n"))).first()
    m, v = m or 0.0, 0.0
    if spread and chance < 1:
        v = (spread - m * (1 - m) * chance) / (1 - chance)
    strength = min(max(m * (1 - m) / v - 1, STRENGTH[0]), STRENGTH[1]) if v > 0 else STRENGTH[1]
    limit = min(max(TIMES * m, LIMITS[0]), LIMITS[1])
    rated = counts.withColumn("rate", (F.col("fails") + m * strength) / (F.col("n") + strength))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    return rated.withColumn("refused", F.col("rate") - SURE * deviation > limit)


def host_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept) per row of ``docs``.

    A document fails by itself (base_failed) with fewer than 10 words or over 20 % of its words in 5-word windows found twice or more in
    it. For its host it also fails with over 0.1 symbols a word or over 30 % of repeated lines. Failures are counted by host (source;
    null is a host of its own), rates are shrunk by an empirical beta prior, and a host that is refused takes all its documents
    with it. Null and empty texts have no words and fail. Repeated rows count each; texts of any length are read whole; an empty
    table gives none. Other columns are ignored.
    """
    checked = cut(rules(docs))
    verdict = cut(hosts(checked).select(F.col("source").alias("_s"), "rate", "refused"))
    out = checked.join(F.broadcast(verdict) if fits(verdict) else verdict, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rate").alias("host_rate"), (~F.col("base_failed") & ~F.col("refused")).alias("kept"))
