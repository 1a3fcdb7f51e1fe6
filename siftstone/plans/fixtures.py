"""Queries of parsers and matchers over made-up inputs, with the rows they must give."""

from __future__ import annotations

import gzip
import hashlib
import io
import sqlite3
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.tables import Rule
from siftstone.operators import catalogs, detect, indicators, rollups, search
from siftstone.operators import yara as yara_rules
from siftstone.plans import inputs
from siftstone.plans.detection import text
from siftstone.session import ship
from siftstone.sources import containers, feeds, targets, web

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def values(columns: str, rows: list[tuple]) -> str:
    shown = ", ".join("(" + ", ".join(str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else text(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) AS t({columns})"


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def _tar(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _database() -> bytes:
    base = sqlite3.connect(":memory:")
    base.execute("CREATE TABLE users (id INTEGER, name TEXT, pic BLOB)")
    base.executemany("INSERT INTO users VALUES (?, ?, ?)", [(1, "ann", b"abcd"), (2, None, None)])
    base.execute("CREATE TABLE empty (x)")
    base.commit()
    return base.serialize()


@query
def expanded_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of nested archives, their level and size."""
    ship(spark)
    deep = _zip({"deep.txt": b"deep", "more.gz": gzip.compress(b"inside")})
    rows = [("/a.zip", _zip({"one.txt": b"one", "b.zip": deep})), ("/c.tar.gz", _tar({"d/e.txt": b"eee"})), ("/broken.zip", b"PK"), ("/plain.txt", b"text")]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    out = containers.expand(files).where("depth > 0 and path not like '%.zip'")
    return out.select("path", "depth", F.octet_length("content").alias("size"), F.col("content").cast("string").alias("said")).where("path not like '%.gz'")


SQL["expanded_archives"] = values("path, depth, size, said", [("/a.zip!one.txt", 1, 3, "one"), ("/a.zip!b.zip!deep.txt", 2, 4, "deep"), ("/a.zip!b.zip!more.gz!more", 3, 6, "inside"), ("/c.tar.gz!d/e.txt", 1, 3, "eee")])


@query
def sqlite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a database as texts."""
    ship(spark)
    files = spark.createDataFrame([("/app.db", bytearray(_database())), ("/fake.db", bytearray(b"no"))], "path string, content binary")
    return containers.expand(files).where("depth > 0").select("path", F.col("content").cast("string").alias("rows"))


SQL["sqlite_rows"] = "SELECT '/app.db!users' AS path, concat('id=1 name=ann pic=<blob 4 bytes>', chr(10), 'id=2', chr(10)) AS rows"


@query
def yara_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YARA rules over documents: texts that hold two words, in any case."""
    ship(spark)
    source = 'rule words { meta: severity = "low" strings: $a = "the" nocase $b = "licens" nocase condition: all of them }\nrule none { strings: $a = "zzqq" condition: $a }'
    files = inputs.files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"))
    return yara_rules.yara(files, [source]).select("rule", "path", "severity")


SQL["yara_matches"] = f"SELECT 'yara:words' AS rule, path, 'low' AS severity FROM ({inputs.FILES}) WHERE contains(lower(text), 'the') AND contains(lower(text), 'licens')"


@query
def clamav_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures over documents: a literal body, a digest, and a digest of the wrong size."""
    files = inputs.files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"))
    lines = ["Words:0:*:" + b"License".hex(), hashlib.md5(b"x").hexdigest() + ":1:X"]
    return indicators.clamav(files, lines).select("rule", "path", "snippet", "severity")


SQL["clamav_matches"] = f"SELECT 'clamav:Words' AS rule, path, 'ClamAV signature \"Words\" matched (body)' AS snippet, 'critical' AS severity FROM ({inputs.FILES}) WHERE contains(text, 'License')"


@query
def run_time_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules given at run time; those that can't be used are left out."""
    rules = [Rule("mit", "MIT License", "low", None), Rule("around", "(?<=a)b", None, None), Rule("ip", "ip:1.2.3.4", None, None)]
    return detect.regex_rules(inputs.files(spark, sf_dir), rules, show=True).groupBy("rule", "severity").agg(F.count("*").alias("n"))


SQL["run_time_rules"] = f"SELECT 'mit' AS rule, 'low' AS severity, n FROM (SELECT CAST(sum(len(regexp_extract_all(text, 'MIT License'))) AS BIGINT) AS n FROM ({inputs.FILES})) WHERE n > 0"

_FEEDS = (
    ("a.txt", "# list\n10.0.0.1\nEvil.com\nno match\n"),
    ("b.csv", "name,pattern,severity\nx,a+,crit\ny,,low\nx,a+,low\n"),
    ("c.json", '{"type": "bundle", "objects": [{"type": "indicator", "pattern": "[url:value = \'http://e/x\']"}]}'),
    ("d.misp", '{"Event": {"Attribute": [{"type": "hostname", "value": "h.com"}]}}'),
    ("e.yar", "rule r { condition: true }"),
    ("f.toml", '[[rules]]\nid = "k"\nregex = "k+"\n'),
    ("g.xml", "<rss><t>at 1.2.3.4</t></rss>"),
)


@query
def feed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of feeds in seven formats."""
    rules = [r for name, body in _FEEDS for r in feeds.ingest("f", name, body.encode())]
    return feeds.first_rules(feeds.rule_table(spark, rules)).select("name", "pattern", "severity")


SQL["feed_rules"] = values("name, pattern, severity", [("f-ioc", "ip:10.0.0.1", "high"), ("f-ioc", "domain:evil.com", "high"), ("x", "a+", "critical"), ("f-ioc", "url:http://e/x", "high"), ("f-ioc", "domain:h.com", "high"), ("yara:r", "yara:rule r { condition: true }", "high"), ("k", "k+", None), ("f-ioc", "ip:1.2.3.4", "high")])


@query
def cwe_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.weaknesses('<c><Weakness ID="79" Name="XSS" Abstraction="Base" Status="Stable"><Description>a  b</Description></Weakness><Weakness ID="20" Name="Input"/></c>')
    return catalogs.weakness(spark.createDataFrame(rows, "id string, name string, abstraction string, status string, description string"), "79")


SQL["cwe_catalog"] = values("id, name, abstraction, status, description", [("CWE-79", "XSS", "Base", "Stable", "a b")])


@query
def sweep_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.sweep(spark, "10.0.0.0/29,gate", "22,80-81")


SQL["sweep_targets"] = "SELECT host, CAST(port AS INTEGER) AS port FROM (SELECT concat('10.0.0.', unnest(range(1, 7))) AS host UNION ALL SELECT 'gate') h, (SELECT unnest([22, 80, 81]) AS port) p"


@query
def banner_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("SSH-2.0-OpenSSH_9.6\r\n",), ("HTTP/1.1 200 OK\r\nServer: nginx/1.2\r\n\r\n",), ("220 mail ESMTP x",), ("?",)], "banner string")
    return rows.withColumn("s", targets.service(F.col("banner"))).select("s.service", "s.version")


SQL["banner_services"] = values("service, version", [("ssh", "OpenSSH_9.6"), ("http", "nginx/1.2"), ("smtp", "mail ESMTP x"), ("", "")])


@query
def private_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages that made-up answers resolve to reserved addresses."""
    rows = inputs.table(spark, sf_dir, "pages").select(F.concat(F.lit("/p"), "page_id").alias("path"), F.lit("d.com").alias("domain"), F.concat(F.when(F.col("page_id") % 3 == 0, "10.").otherwise("8."), F.lit("1.1."), F.col("page_id") % 200).alias("address"))
    return indicators.private_resolutions(rows).select("rule", "path", "snippet", "severity")


SQL["private_resolutions"] = "SELECT 'dns-private-resolution' AS rule, concat('/p', page_id) AS path, concat('d.com resolves to reserved address(es): 10.1.1.', page_id % 200) AS snippet, 'medium' AS severity FROM pages WHERE page_id % 3 = 0"


@query
def young_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that made-up registry answers date to the last 30 days."""
    said = F.concat(F.lit("Domain: x\nCreation Date: "), F.date_sub(F.lit("2026-03-01").cast("date"), F.col("page_id").cast("int") % 60), F.lit("T00:00:00Z\n"))
    rows = inputs.table(spark, sf_dir, "pages").select(F.concat(F.lit("/p"), "page_id").alias("path"), F.lit("d.com").alias("domain"), said.alias("response"))
    return indicators.young_domains(rows, "2026-03-01").select("rule", "path", "snippet")


SQL["young_domains"] = "SELECT 'whois-newly-registered' AS rule, concat('/p', page_id) AS path, concat('d.com registered ', page_id % 60, ' day(s) ago') AS snippet FROM pages WHERE page_id % 60 <= 30"


@query
def page_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up site, breadth first from one page, two links deep, on its own host."""
    pages = spark.createDataFrame([("http://h/a", "<a href='b'>"), ("http://h/b", "<a href='/c'><a href='http://o/x'>"), ("http://h/c", "<a href='d'>"), ("http://h/d", ""), ("http://o/x", "")], "url string, html string")
    return web.crawl(pages, pages.limit(1))


SQL["page_crawl"] = "SELECT url, CAST(depth AS INTEGER) AS depth FROM (VALUES ('http://h/a', 0), ('http://h/b', 1), ('http://h/c', 2)) t(url, depth)"


@query
def rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in rules that speak of tokens."""
    from siftstone.functions.tables import SECRETS

    rows = spark.createDataFrame([(r.name, r.description, r.severity, r.cwe) for r in SECRETS], "name string, description string, severity string, cwe string")
    return search.rules_matching(rows, "Token").select("name", "severity")


SQL["rule_listing"] = values("name, severity", [("github-token", "critical"), ("slack-token", "high")])


@query
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a made-up scan of all documents."""
    n = F.col("doc_id") % 5
    status = F.when(n == 0, "unchanged").when(n == 1, "skipped").when(n == 2, "unreadable").otherwise("scanned")
    return rollups.scan_summary(inputs.table(spark, sf_dir, "documents").select(status.alias("status"), F.when(n == 3, 2).otherwise(0).alias("matches")))


SQL["scan_counters"] = """WITH s AS (SELECT doc_id % 5 AS n FROM documents) SELECT count(*) AS candidates, count(*) FILTER (n > 2) AS scanned, count(*) FILTER (n = 0) AS unchanged, CAST(0 AS BIGINT) AS oversize,
    count(*) FILTER (n = 2) AS unreadable, count(*) FILTER (n = 1) AS skipped, CAST(2 * count(*) FILTER (n = 3) AS BIGINT) AS matches, (count(*) - count(*) FILTER (n = 1)) / count(*) AS coverage FROM s"""


@query
def path_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that is trained on made-up labels (rows only: an iterative fit)."""
    from siftstone.model import classifier
    from siftstone.plans.ranking import _samples

    ship(spark)
    rows = _samples(spark, sf_dir).select("path", F.col("path").endswith(".ENV").alias("has_finding"))
    return classifier.score(rows, classifier.train(rows, states=2, rounds=3))
