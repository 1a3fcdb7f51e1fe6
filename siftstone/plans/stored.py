"""Queries of the stored graph, scans and catalogue over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.tables import SECRETS
from siftstone.operators import catalogs, graph, rollups, search
from siftstone.plans import inputs
from siftstone.plans.detection import text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per file version whose document number is divisible by three."""
    v = inputs.versions(spark, sf_dir)
    number = F.regexp_extract("abs", "([0-9]+)$", 1).cast("long")
    return v.where(number % 3 == 0).select(F.concat("scan_id", F.lit("/"), "abs").alias("finding_id"), F.col("hash").alias("file_hash"), F.concat(F.lit("rule-"), number % 5).alias("rule"), F.col("abs").alias("path"), F.lit(1).alias("line"), F.lit("high").alias("severity"))


_NUMBER = "CAST(regexp_extract(abs, '([0-9]+)$', 1) AS BIGINT)"
_FINDINGS = f"SELECT concat(scan_id, '/', abs) AS finding_id, hash AS file_hash, concat('rule-', {_NUMBER} % 5) AS rule, abs AS path, 'high' AS severity FROM ({inputs.VERSIONS}) WHERE {_NUMBER} % 3 = 0"


@query
def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest_scan(inputs.scans(spark))


SQL["latest_scan"] = f"SELECT * FROM ({inputs.SCANS_SQL}) ORDER BY started_at DESC, scan_id DESC LIMIT 1"


@query
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of runs by their start, in UTC."""
    return inputs.scans(spark).select("scan_id", F.date_format(F.timestamp_millis("started_at"), "yyyy-MM-dd'T'HH-mm-ss").alias("run"))


SQL["run_names"] = f"SELECT scan_id, strftime(make_timestamp(started_at * 1000), '%Y-%m-%dT%H-%M-%S') AS run FROM ({inputs.SCANS_SQL})"


@query
def last_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path per content, that of the last scan."""
    return graph.newest(inputs.versions(spark, sf_dir).select("hash", "abs", "size", "scan_id"), "hash", F.struct("scan_id", "abs"))


SQL["last_version"] = f"SELECT hash, arg_max(abs, scan_id || abs) AS abs, arg_max(size, scan_id || abs) AS size, max(scan_id) AS scan_id FROM ({inputs.VERSIONS}) GROUP BY hash"


@query
def unchanged_vs_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the second scan against the first: unchanged or not, and how many bytes."""
    v = inputs.versions(spark, sf_dir)
    rows = graph.unchanged(v.where("scan_id = 's2'"), v.where("scan_id = 's1'"))
    return rows.groupBy("unchanged").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


SQL["unchanged_vs_changed"] = f"WITH v AS ({inputs.VERSIONS}) SELECT coalesce(a.size = b.size AND a.mtime = b.mtime, false) AS unchanged, count(*) AS files, CAST(sum(a.size) AS BIGINT) AS bytes FROM v a LEFT JOIN v b ON a.abs = b.abs AND b.scan_id = 's1' WHERE a.scan_id = 's2' GROUP BY 1"


@query
def search_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in files of the runs of a name."""
    includes = inputs.versions(spark, sf_dir).select("scan_id", "hash")
    return search.matching(_findings(spark, sf_dir), "run=second", inputs.scans(spark), includes).select("finding_id", "file_hash", "rule", "path", "severity")


SQL["search_run"] = f"SELECT * FROM ({_FINDINGS}) WHERE file_hash IN (SELECT hash FROM ({inputs.VERSIONS}) WHERE scan_id = 's2')"


@query
def gc_live_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are left of each table when garbage is collected."""
    v = inputs.versions(spark, sf_dir)
    tables = {"scan": inputs.scans(spark), "includes": v.select("scan_id", "hash"), "file": v.select("hash").distinct(), "finding": _findings(spark, sf_dir)}
    left = graph.collect_garbage(tables)
    out = None
    for name, rows in left.items():
        one = rows.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


SQL["gc_live_set"] = f"""WITH v AS ({inputs.VERSIONS}), k AS (SELECT DISTINCT hash FROM v WHERE scan_id = 's2')
    SELECT 'scan' AS "table", CAST(1 AS BIGINT) AS n UNION ALL SELECT 'includes', count(*) FROM v WHERE scan_id = 's2' UNION ALL SELECT 'file', count(*) FROM k UNION ALL SELECT 'finding', count(*) FROM ({_FINDINGS}) WHERE file_hash IN (SELECT hash FROM k)"""


@query
def removed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusions left when the runs of a name are removed."""
    _, includes = graph.without_run(inputs.scans(spark), inputs.versions(spark, sf_dir).select("scan_id", "hash"), "first")
    return includes.groupBy("scan_id").agg(F.count("*").alias("n"))


SQL["removed_run"] = f"SELECT scan_id, count(*) AS n FROM ({inputs.VERSIONS}) WHERE scan_id <> 's1' GROUP BY scan_id"


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as containers: each lies in the one of a third of its number, up to 200 of them."""
    d = inputs.table(spark, sf_dir, "documents").where("doc_id > 0")
    return d.select(F.concat(F.lit("h"), "doc_id").alias("inner"), F.concat(F.lit("h"), F.floor(F.col("doc_id") / 3)).alias("container"))


@query
def container_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_chain(spark, sf_dir))


SQL["container_closure"] = """WITH RECURSIVE c AS (SELECT concat('h', doc_id) AS i, concat('h', doc_id // 3) AS o FROM documents WHERE doc_id > 0),
    r AS (SELECT i, o, 1 AS d FROM c UNION SELECT r.i, c.o, r.d + 1 FROM r JOIN c ON r.o = c.i WHERE r.d < 8) SELECT DISTINCT i AS "inner", o AS container FROM r"""


def _graph(spark: SparkSession, sf_dir: str):
    v = inputs.versions(spark, sf_dir)
    files = graph.newest(v.select("hash", F.col("abs").alias("path"), "scan_id"), "hash", "scan_id")
    rules = spark.createDataFrame([(f"rule-{i}",) for i in range(4)], "name string")
    return graph.findings_graph(_findings(spark, sf_dir), files, rules)


@query
def findings_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


_EDGES = f"SELECT 'in_file' AS rel, concat('finding:', finding_id) AS src, concat('file:', file_hash) AS dst FROM ({_FINDINGS}) UNION ALL SELECT 'flagged_by', concat('finding:', finding_id), concat('rule:', rule) FROM ({_FINDINGS}) WHERE rule <> 'rule-4'"
SQL["findings_graph_edges"] = _EDGES


@query
def findings_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].groupBy("kind").agg(F.count("*").alias("n"))


SQL["findings_graph_nodes"] = f"SELECT 'finding' AS kind, count(*) AS n FROM ({_FINDINGS}) UNION ALL SELECT 'file', count(DISTINCT hash) FROM ({inputs.VERSIONS}) UNION ALL SELECT 'rule', CAST(4 AS BIGINT)"


@query
def neighbors_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges at three of the rules."""
    nodes, edges = _graph(spark, sf_dir)
    ids = spark.createDataFrame([("rule:rule-0",), ("rule:rule-1",), ("rule:none",)], "id string")
    return graph.neighbours(edges, nodes, ids)


SQL["neighbors_one_hop"] = f"SELECT dst AS id, rel, 'in' AS direction, src AS other, concat(f.rule, ' @ ', f.path, ':1') AS label FROM ({_EDGES}) e JOIN ({_FINDINGS}) f ON e.src = concat('finding:', f.finding_id) WHERE dst IN ('rule:rule-0', 'rule:rule-1')"


@query
def ruleset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.fingerprint(spark.createDataFrame([(r.name, r.pattern) for r in SECRETS], "name string, pattern string"))


SQL["ruleset_fingerprint"] = "SELECT left(sha256(string_agg(l, chr(10) ORDER BY l)), 16) AS ruleset FROM (VALUES " + ", ".join(f"({text(r.name + '=' + r.pattern)})" for r in SECRETS) + ") t(l)"


@query
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with whether any finding is in them."""
    v = inputs.versions(spark, sf_dir).where("scan_id = 's2'")
    flagged = _findings(spark, sf_dir).select(F.col("file_hash").alias("hash"), F.lit(True).alias("f")).distinct()
    return v.join(flagged, "hash", "left").select(F.col("abs").alias("path"), F.coalesce("f", F.lit(False)).alias("has_finding"))


SQL["training_labels"] = f"SELECT abs AS path, hash IN (SELECT file_hash FROM ({_FINDINGS})) AS has_finding FROM ({inputs.VERSIONS}) WHERE scan_id = 's2'"


@query
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.totals(inputs.versions(spark, sf_dir).select("hash").distinct(), inputs.scans(spark), _findings(spark, sf_dir))


SQL["store_totals"] = f"SELECT (SELECT count(DISTINCT hash) FROM ({inputs.VERSIONS})) AS files, (SELECT count(*) FROM ({inputs.SCANS_SQL})) AS scans, (SELECT count(*) FROM ({_FINDINGS})) AS findings"

_RULES = [("a", "p1", "first"), ("a", "p1", "second"), ("b", "p2", "second"), ("c", "p3", "third")]


@query
def dataset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by content after three rule sets are put in, one is replaced and one dropped (its rules stay, unreached)."""
    rules = spark.createDataFrame([], "rule_id string, name string, pattern string")
    edges, sets = spark.createDataFrame([], "rule_id string, dataset string"), spark.createDataFrame([], "name string, rules long")
    for name in ("first", "second", "third", "second"):
        fresh = spark.createDataFrame([(n, p) for n, p, d in _RULES if d == name], "name string, pattern string")
        rules, edges, sets = catalogs.put_dataset(rules, edges, sets, name, fresh)
    edges, sets = catalogs.drop_dataset(edges, sets, "third")
    return catalogs.rules_of(rules, edges).select("name", "pattern")


SQL["dataset_rules"] = "SELECT * FROM (VALUES ('a', 'p1'), ('b', 'p2')) t(name, pattern)"


@query
def cwe_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the name of their weakness."""
    cwe = spark.createDataFrame([("79", "Cross-site scripting"), ("798", "Hard-coded credentials")], "id string, name string")
    rows = _findings(spark, sf_dir).withColumn("cwe", F.when(F.col("rule") == "rule-1", "CWE-798").when(F.col("rule") == "rule-2", "CWE-1"))
    return rollups.annotated(rows, cwe).groupBy("cwe", "cwe_name").agg(F.count("*").alias("n"))


SQL["cwe_annotation"] = f"SELECT CASE rule WHEN 'rule-1' THEN 'CWE-798' WHEN 'rule-2' THEN 'CWE-1' END AS cwe, CASE rule WHEN 'rule-1' THEN 'Hard-coded credentials' END AS cwe_name, count(*) AS n FROM ({_FINDINGS}) GROUP BY ALL"


@query
def replaced_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by scan when the files of the second are scanned again without finding anything."""
    found = _findings(spark, sf_dir)
    scanned = inputs.versions(spark, sf_dir).where("scan_id = 's2'").select("hash")
    return graph.replaced(found, found.limit(0), scanned).groupBy("rule").agg(F.count("*").alias("n"))


SQL["replaced_findings"] = f"SELECT rule, count(*) AS n FROM ({_FINDINGS}) WHERE file_hash NOT IN (SELECT hash FROM ({inputs.VERSIONS}) WHERE scan_id = 's2') GROUP BY rule"
