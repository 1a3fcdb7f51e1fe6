"""Views over the given tables that the queries read, in Spark and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files: path, text, file_hash."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).where("text is not null")
    path = F.concat(F.lit("/corpus/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc"), F.col("doc_id"), F.lit(".txt"))
    return docs.select(path.alias("path"), "text")


FILES = "SELECT concat('/corpus/', coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/doc', doc_id, '.txt') AS path, text FROM documents WHERE text IS NOT NULL"


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lines of log files: a line per event, a file per event."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    user, src = F.concat(F.lit("user"), F.col("user_id")), F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256)
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed password for "), user, F.lit(" from "), src, F.lit(" port 22")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Accepted publickey for "), user, F.lit(" from "), src, F.lit(" port 22")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Invalid user "), user, F.lit(" from "), src))
        .otherwise(F.concat(F.lit("session "), F.col("event_id"), F.lit(" idle")))
    )
    return e.select(F.concat(F.lit("/var/log/host"), F.col("user_id") % 50, F.lit("/"), F.col("event_id"), F.lit(".log")).alias("path"), line.alias("text"))


LOG_FILES = """SELECT concat('/var/log/host', user_id % 50, '/', event_id, '.log') AS path,
    CASE event_type WHEN 'error' THEN concat('Failed password for user', user_id, ' from 10.0.', user_id % 256, '.', event_id % 256, ' port 22')
        WHEN 'click' THEN concat('Accepted publickey for user', user_id, ' from 10.0.', user_id % 256, '.', event_id % 256, ' port 22')
        WHEN 'signup' THEN concat('Invalid user user', user_id, ' from 10.0.', user_id % 256, '.', event_id % 256)
        ELSE concat('session ', event_id, ' idle') END AS text FROM events"""


def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as configuration lines that hold made-up credentials."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    key = F.lpad(F.col("o_orderkey").cast("string"), 16, "0")
    kind = F.col("o_orderkey") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("first line\nexport AWS_ACCESS_KEY_ID=AKIA"), key))
        .when(kind == 1, F.concat(F.lit("api_key = 'k"), key, F.lit("'")))
        .when(kind == 2, F.concat(F.lit("url: postgres://u"), F.col("o_custkey"), F.lit(":p"), F.col("o_orderkey"), F.lit("@db"), F.lit(" and AKIA"), key, F.lit(" twice AKIA"), key))
        .otherwise(F.concat(F.lit("nothing here "), key))
    )
    return o.select(F.concat(F.lit("/srv/c"), F.col("o_custkey") % 20, F.lit("/order"), F.col("o_orderkey"), F.lit(".env")).alias("path"), line.alias("text"))


SECRET_FILES = """SELECT concat('/srv/c', o_custkey % 20, '/order', o_orderkey, '.env') AS path,
    CASE o_orderkey % 4 WHEN 0 THEN concat('first line', chr(10), 'export AWS_ACCESS_KEY_ID=AKIA', lpad(CAST(o_orderkey AS VARCHAR), 16, '0'))
        WHEN 1 THEN concat('api_key = ''k', lpad(CAST(o_orderkey AS VARCHAR), 16, '0'), '''')
        WHEN 2 THEN concat('url: postgres://u', o_custkey, ':p', o_orderkey, '@db and AKIA', lpad(CAST(o_orderkey AS VARCHAR), 16, '0'), ' twice AKIA', lpad(CAST(o_orderkey AS VARCHAR), 16, '0'))
        ELSE concat('nothing here ', lpad(CAST(o_orderkey AS VARCHAR), 16, '0')) END AS text FROM orders"""

#: Two scans of the corpus: all files, then those whose number isn't a multiple of ten, some of them changed since.
SCANS = [("s1", "first", "/corpus", 1785766925000), ("s2", "second", "/corpus", 1785853325000)]


def scans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCANS, "scan_id string, name string, root string, started_at long")


SCANS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', CAST({d} AS BIGINT))" for a, b, c, d in SCANS) + ") AS t(scan_id, name, root, started_at)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, abs, size, mtime, hash) of every file of each scan; every seventh has changed in the second."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    path = F.concat(F.lit("/corpus/doc"), F.col("doc_id"))
    one = d.select(F.lit("s1").alias("scan_id"), path.alias("abs"), F.col("n_chars").alias("size"), F.lit("100.000000000").alias("mtime"), F.md5(F.concat(F.lit("v1"), F.col("doc_id").cast("string")).cast("binary")).alias("hash"))
    changed = F.col("doc_id") % 7 == 0
    two = d.where("doc_id % 10 <> 0").select(F.lit("s2").alias("scan_id"), path.alias("abs"), F.col("n_chars").alias("size"), F.when(changed, "200.000000000").otherwise("100.000000000").alias("mtime"), F.md5(F.concat(F.when(changed, "v2").otherwise("v1"), F.col("doc_id").cast("string")).cast("binary")).alias("hash"))
    return one.unionByName(two)


VERSIONS = """SELECT 's1' AS scan_id, concat('/corpus/doc', doc_id) AS abs, n_chars AS size, '100.000000000' AS mtime, md5(concat('v1', doc_id)) AS hash FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT 's2', concat('/corpus/doc', doc_id), n_chars, CASE WHEN doc_id % 7 = 0 THEN '200.000000000' ELSE '100.000000000' END, md5(concat(CASE WHEN doc_id % 7 = 0 THEN 'v2' ELSE 'v1' END, doc_id)) FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 0"""
