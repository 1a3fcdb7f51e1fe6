"""Queries of the path model, ranking and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import paths
from siftstone.operators import ranking
from siftstone.plans import inputs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paths with made-up labels, sizes and scores."""
    d = inputs.table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, ".ENV").when(F.col("doc_id") % 5 == 1, "").otherwise(".txt")
    path = F.concat(F.lit("/Corpus/"), F.coalesce("source", F.lit("none")), F.lit("/./"), F.coalesce("lang", F.lit("none")), F.lit("/doc"), F.col("doc_id"), kind)
    return d.select(path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 11 == 0).alias("has_finding"), (F.col("doc_id") % 13 == 0).alias("changed"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("score"))


_SAMPLES = """SELECT concat('/Corpus/', coalesce(source, 'none'), '/./', coalesce(lang, 'none'), '/doc', doc_id, CASE doc_id % 5 WHEN 0 THEN '.ENV' WHEN 1 THEN '' ELSE '.txt' END) AS path,
    n_chars AS size, doc_id % 11 = 0 AS has_finding, doc_id % 13 = 0 AS changed, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM documents"""
_TOKENS = """list_transform(list_filter(string_split_regex(path, '[/!]'), lambda p: p <> '' AND p <> '.'), lambda p, i: CASE WHEN i < len(list_filter(string_split_regex(path, '[/!]'), lambda q: q <> '' AND q <> '.')) THEN lower(p)
    WHEN contains(p, '.') THEN concat('<ext:', lower(regexp_extract(p, '\\.([^.]+)$', 1)), '>') ELSE '<noext>' END)"""


@query
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("path", F.array_join(paths.tokens(F.col("path")), " ").alias("tokens"))


SQL["path_tokens"] = f"SELECT path, array_to_string({_TOKENS}, ' ') AS tokens FROM ({_SAMPLES})"


@query
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent tokens (a top-k report)."""
    return ranking.vocabulary(_samples(spark, sf_dir).select(paths.tokens(F.col("path")).alias("tokens")), 20)


SQL["vocab_topk"] = f"SELECT token, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id FROM (SELECT unnest({_TOKENS}) AS token FROM ({_SAMPLES})) GROUP BY token ORDER BY n DESC, token LIMIT 20"


@query
def dir_prior_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir)
    train = rows.where("size % 3 <> 0")
    scored = ranking.prior_scores(rows.where("size % 3 = 0").drop("score"), ranking.directory_prior(train), train)
    return scored.select("path", F.round("score", 6).alias("score"))


_PARENT = "regexp_extract(path, '^(.*)[/!][^/!]*$', 1)"
SQL["dir_prior_scores"] = f"""WITH s AS ({_SAMPLES}), t AS (SELECT * FROM s WHERE size % 3 <> 0), p AS (SELECT {_PARENT} AS dir, (count(*) FILTER (has_finding) + 1) / (count(*) + 2) AS rate FROM t GROUP BY 1)
    SELECT path, round(coalesce(rate, (SELECT (count(*) FILTER (has_finding) + 1) / (count(*) + 2) FROM t)), 6) AS score FROM s LEFT JOIN p ON p.dir = regexp_extract(s.path, '^(.*)[/!][^/!]*$', 1) WHERE size % 3 = 0"""


@query
def rank_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_samples(spark, sf_dir)).select("path", "rk")


_RANKED = f"SELECT *, row_number() OVER (ORDER BY changed DESC, score / greatest(size, 4096) DESC, path) AS rk FROM ({_SAMPLES})"
SQL["rank_by_value"] = f"SELECT path, rk FROM ({_RANKED})"


@query
def bytes_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cut(ranking.ranked(_samples(spark, sf_dir)), ranking.parse_budget("500kb")).select("path", "rk")


SQL["bytes_budget"] = f"SELECT path, rk FROM (SELECT *, sum(size) OVER (ORDER BY rk) AS s FROM ({_RANKED})) WHERE s <= 512000"


@query
def fraction_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cut(ranking.ranked(_samples(spark, sf_dir)), ranking.parse_budget("15%")).select("path", "rk")


SQL["fraction_budget"] = f"SELECT path, rk FROM ({_RANKED}) WHERE rk <= (SELECT ceil(count(*) * 0.15) FROM documents)"


@query
def files_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cut(ranking.ranked(_samples(spark, sf_dir)), ranking.parse_budget("100")).select("path", "rk")


SQL["files_budget"] = f"SELECT path, rk FROM ({_RANKED}) WHERE rk <= 100"


@query
def confidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("score", F.floor(F.col("score") * 1000).cast("double"))
    return ranking.cut(ranking.ranked(rows), ranking.parse_budget("60c")).select("path", "rk")


_WHOLE = f"SELECT * REPLACE (floor(score * 1000) AS score) FROM ({_SAMPLES})"
SQL["confidence_budget"] = f"SELECT path, rk FROM (SELECT path, rk, score, coalesce(sum(score) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(score) OVER () AS t FROM (SELECT *, row_number() OVER (ORDER BY changed DESC, score / greatest(size, 4096) DESC, path) AS rk FROM ({_WHOLE}))) WHERE rk = 1 OR b < 0.6 * t"


@query
def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.recall(_samples(spark, sf_dir).select("path", "score", "has_finding"))
    return rows.select("budget", F.round("recall", 6).alias("recall"), F.round("lift", 6).alias("lift"))


SQL["recall_at_budget"] = f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS k, count(*) OVER () AS n FROM ({_SAMPLES})), b AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.75]::DOUBLE[]) AS budget)
    SELECT budget, round(count(*) FILTER (has_finding AND k <= ceil(n * budget)) / count(*) FILTER (has_finding), 6) AS recall, round(count(*) FILTER (has_finding AND k <= ceil(n * budget)) / count(*) FILTER (has_finding) / budget, 6) AS lift FROM r, b GROUP BY budget"""


@query
def brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.calibration(_samples(spark, sf_dir))
    return rows.select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


SQL["brier_ece"] = f"""WITH b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, sum(score) AS s, sum(CAST(has_finding AS INTEGER)) AS h, sum(power(score - CAST(has_finding AS INTEGER), 2)) AS e FROM ({_SAMPLES}) GROUP BY 1)
    SELECT round(sum(e) / sum(n), 6) AS brier, round(sum(abs(s - h)) / sum(n), 6) AS ece FROM b"""
