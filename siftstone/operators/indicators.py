"""Indicators of texts, and joins of indicators and digests with lists of known-bad values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import matching as m
from siftstone.functions import names
from siftstone.functions.schemes import DIGESTS, scheme_of, value_of
from siftstone.functions.tables import BRANDS, INDICATOR_CAP, INDICATORS

#: A list of known-bad values of at most so many rows may be broadcast; longer lists are joined by shuffle.
LIST_ROWS = 200_000


def _capped(values: Column) -> Column:
    """Distinct values: the first INDICATOR_CAP found, sorted."""
    return F.array_sort(F.slice(F.array_distinct(values), 1, INDICATOR_CAP))


#: What a text has wherever an indicator of a kind is; much cheaper to look for.
_HINTS = {"emails": "@", "urls": "://", "ips": r"\p{Nd}\.\p{Nd}", "domains": r"[A-Za-z0-9]\.[A-Za-z0-9]", "hashes": "[a-fA-F0-9]{32}"}


def _all(kind: str) -> Column:
    found = F.regexp_extract_all("text", F.lit(m.java(INDICATORS[kind])), F.lit(0))
    return F.when(F.col("text").rlike(_HINTS[kind]), found).when(F.col("text").isNotNull(), F.array().cast("array<string>"))


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.cast("int") <= 255)


def indicators(files: DataFrame) -> DataFrame:
    """The columns of ``files`` but text, and emails, domains, ips, urls and hashes: distinct values of each, sorted."""
    keep = [c for c in files.columns if c != "text"]
    return files.select(
        *keep,
        _capped(F.transform(_all("emails"), F.lower)).alias("emails"),
        _capped(F.transform(F.filter(_all("domains"), lambda d: ~(d.rlike(r"^[0-9.]+$") & F.coalesce(_octets(d), F.lit(False)))), F.lower)).alias("domains"),
        _capped(F.filter(_all("ips"), _octets)).alias("ips"),
        _capped(_all("urls")).alias("urls"),
        _capped(F.transform(_all("hashes"), F.lower)).alias("hashes"),
    )


def _bounded(side: DataFrame) -> DataFrame:
    """A small side, marked for broadcast if it is within LIST_ROWS rows."""
    return F.broadcast(side) if side.limit(LIST_ROWS + 1).count() <= LIST_ROWS else side


def ioc_table(rules: DataFrame) -> DataFrame:
    """(kind, value, name, severity, cwe) of rules whose pattern is an indicator; of equal values the last rule (by rule_ord) counts."""
    rows = rules.select(scheme_of(F.col("pattern")).alias("kind"), value_of(F.col("pattern")).alias("value"), F.struct("rule_ord", "name", "severity", "cwe").alias("r")).where("kind is not null")
    return rows.groupBy("kind", "value").agg(F.max("r").alias("r")).select("kind", "value", "r.name", "r.severity", "r.cwe")


def _finding(rule: Column, snippet: Column, severity: Column, cwe: Column, line: int) -> list[Column]:
    return [rule.alias("rule"), F.col("path"), F.lit(line).alias("line"), F.lit(1).alias("col"), snippet.alias("snippet"), severity.alias("severity"), cwe.alias("cwe"), F.lit(None).cast("string").alias("cve")]


def hash_iocs(files: DataFrame, iocs: DataFrame, content: str = "text") -> DataFrame:
    """Findings of files whose MD5, SHA-1 or SHA-256 is listed. Only text files (no NUL in the first 8192 bytes) are compared."""
    octets = F.col(content).cast("binary")
    each = F.array(F.struct(F.lit("md5").alias("kind"), F.md5(octets).alias("value")), F.struct(F.lit("sha1").alias("kind"), F.sha1(octets).alias("value")), F.struct(F.lit("sha256").alias("kind"), F.sha2(octets, 256).alias("value")))
    digests = files.where(~is_binary(octets)).select("path", F.explode(each).alias("d")).select("path", "d.kind", "d.value")
    listed = iocs.where(F.col("kind").isin(*DIGESTS))
    found = digests.join(_bounded(listed), ["kind", "value"])
    said = F.when(F.col("kind") == "md5", "Md5").when(F.col("kind") == "sha1", "Sha1").otherwise("Sha256")
    return found.select(*_finding(F.col("name"), F.concat(F.lit("file "), said, F.lit(' digest matches IOC "'), F.col("name"), F.lit('"')), F.coalesce("severity", F.lit("critical")), F.coalesce("cwe", F.lit("CWE-506")), 1))


def is_binary(content: Column) -> Column:
    """A NUL in the first 8192 bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 8192)) > 0


def network_iocs(found: DataFrame, iocs: DataFrame) -> DataFrame:
    """Findings of listed domains (of a domain's own name and its parents the nearest), addresses and URLs among indicators."""
    listed = _bounded(iocs.where(F.col("kind").isin("domain", "ip", "url")))
    domain = found.select("path", F.explode("domains").alias("seen")).select("path", "seen", F.lit("domain").alias("kind"), F.posexplode(names_and_parents(F.col("seen"))).alias("rank", "value"))
    others = [found.select("path", F.explode(c).alias("seen")).select("path", "seen", F.lit(k).alias("kind"), F.lit(0).alias("rank"), F.col("seen").alias("value")) for c, k in (("ips", "ip"), ("urls", "url"))]
    met = domain.union(others[0]).union(others[1]).join(listed, ["kind", "value"])
    nearest = met.groupBy("path", "kind", "seen").agg(F.min_by(F.struct("name", "severity", "cwe"), "rank").alias("r"))
    return nearest.select(*_finding(F.col("r.name"), F.concat(F.lit("known-bad "), F.col("kind"), F.lit(": "), F.col("seen")), F.coalesce("r.severity", F.lit("critical")), F.coalesce("r.cwe", F.lit("CWE-506")), 0))


def names_and_parents(domain: Column) -> Column:
    """The name, and what is left after each dot, nearest first."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def breached(found: DataFrame, iocs: DataFrame) -> DataFrame:
    """Findings of e-mail addresses that are listed, in plain or as SHA-1."""
    listed = iocs.where("kind = 'breach-email'").select("value").distinct()
    keys = found.select("path", F.explode("emails").alias("email")).withColumn("value", F.explode(F.array(F.lower("email"), F.sha1(F.lower("email").cast("binary")))))
    met = keys.join(_bounded(listed), "value", "left_semi").select("path", "email").distinct()
    return met.select(*_finding(F.lit("breach-email"), F.concat(F.lit("email in breach corpus: "), F.col("email")), F.lit("high"), F.lit("CWE-359"), 0))


def judge_domain(domain: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """(rule, brand) of a domain that mimics a brand or has one as a subdomain; null if none. Brands are tried in
    order and the first to say anything decides; a domain whose registered label is that brand is its own."""
    labels = F.split(domain, r"\.")
    label = F.get(labels, F.size(labels) - 2)
    above = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    nothing = F.lit(None).cast("struct<rule:string,brand:string>")

    def one(brand: Column) -> Column:
        said = F.when(label == brand, F.struct(F.lit("").alias("rule"), brand.alias("brand")))
        said = said.when(names.impersonates(label, brand), F.struct(F.lit("typosquat-domain").alias("rule"), brand.alias("brand")))
        return said.when(F.array_contains(above, brand), F.struct(F.lit("brand-subdomain").alias("rule"), brand.alias("brand"))).otherwise(nothing)

    first = F.get(F.filter(F.transform(F.array(*map(F.lit, brands)), one), lambda x: x.isNotNull()), 0)
    return F.when((F.size(labels) >= 2) & (first["rule"] != ""), first).otherwise(nothing)


def typosquat_domains(found: DataFrame, brands: tuple[str, ...] = BRANDS) -> DataFrame:
    """Findings of domains that pass for a brand. Each distinct domain is judged once."""
    seen = found.select("path", F.explode("domains").alias("domain"))
    judged = seen.select("domain").distinct().withColumn("j", judge_domain(F.col("domain"), brands)).where("j is not null")
    rows = seen.join(judged, "domain")
    q = F.lit('"')
    said = F.when(F.col("j.rule") == "typosquat-domain", F.concat(F.lit("domain "), q, F.col("domain"), q, F.lit(" mimics brand "), q, F.col("j.brand"), q)).otherwise(F.concat(F.lit("brand "), q, F.col("j.brand"), q, F.lit(" used as a subdomain in "), q, F.col("domain"), q))
    return rows.select(*_finding(F.col("j.rule"), said, F.lit("high"), F.lit("CWE-1007"), 0))


def private_resolutions(resolved: DataFrame) -> DataFrame:
    """Findings of (path, domain, address) rows, one per path and domain with a reserved address among its addresses."""
    rows = resolved.where(names.reserved(F.col("address"))).groupBy("path", "domain").agg(F.array_join(F.array_sort(F.collect_set("address")), ", ").alias("found"))
    return rows.select(*_finding(F.lit("dns-private-resolution"), F.concat(F.col("domain"), F.lit(" resolves to reserved address(es): "), F.col("found")), F.lit("medium"), F.lit("CWE-918"), 0))


#: Fields of a registry answer that date a registration, in order; fixed values.
CREATED = ("creation date:", "created:", "created on:", "registered on:", "registration time:", "domain registration date:")


def registered(response: Column) -> Column:
    """Date of registration in a registry answer: of the first field that it has, a leading YYYY-MM-DD; else null."""
    fields = [F.regexp_extract(response, rf"(?im)^\s*\Q{key}\E[ \t]*(\S[^\r\n]*)", 1) for key in CREATED]
    stated = F.coalesce(*[F.when(f != "", f) for f in fields])
    return F.try_to_timestamp(F.regexp_extract(stated, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd")).cast("date")


def young_domains(answers: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Findings of (path, domain, response) registry answers whose registration is 0 to ``days`` days before ``today``."""
    rows = answers.withColumn("age", F.date_diff(F.lit(today).cast("date"), registered(F.col("response")))).where(F.col("age").between(0, days))
    return rows.select(*_finding(F.lit("whois-newly-registered"), F.concat(F.col("domain"), F.lit(" registered "), F.col("age"), F.lit(" day(s) ago")), F.lit("medium"), F.lit("CWE-1007"), 0))


def clamav_signatures(lines: list[str]) -> tuple[list[tuple[str, str, int | None, str]], list[tuple[str, bytes]], int]:
    """Hash signatures (kind, digest, size or None, name), literal body signatures (name, bytes), and how many were skipped."""
    hashes, bodies, skipped = [], [], 0
    for line in lines:
        parts = line.strip().split(":")
        if not line.strip() or line.startswith("#"):
            continue
        if len(parts) >= 3 and len(parts[0]) in (32, 64) and all(c in "0123456789abcdefABCDEF" for c in parts[0]):
            if parts[1] == "*" or parts[1].isdigit():
                hashes.append(("md5" if len(parts[0]) == 32 else "sha256", parts[0].lower(), None if parts[1] == "*" else int(parts[1]), parts[2]))
                continue
        if len(parts) >= 4 and parts[3]:
            try:
                bodies.append((parts[0], bytes.fromhex(parts[3])))
                continue
            except ValueError:
                pass
        skipped += 1
    return hashes, bodies, skipped


def _bodies(held: Broadcast):
    """All bodies are looked for at once, by one automaton (one by one where its package isn't there), so their number hardly counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, list[str]] = {}
        for name, body in held.value:
            if body:
                names.setdefault(bytes(body), []).append(name)
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for body in names:
                automaton.add_word(body.decode("latin-1"), body)
            automaton.make_automaton()
            within = lambda data: {body for _, body in automaton.iter(data.decode("latin-1"))}
        except ImportError:
            within = lambda data: {body for body in names if body in data}
        for batch in batches:
            found = [(path, name) for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) if data and names for body in within(data) for name in names[body]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())], ["path", "name"])

    return scan


def clamav(files: DataFrame, lines: list[str], content: str = "content") -> DataFrame:
    """Findings of malware signatures on any content: digests, gated by size where one is given, and literal bodies."""
    spark = files.sparkSession
    hashes, bodies, _ = clamav_signatures(lines)
    octets = F.col(content).cast("binary")
    out = []
    if hashes:
        table = spark.createDataFrame(hashes, "kind string, value string, size long, name string").dropDuplicates(["kind", "value"])
        each = F.array(F.struct(F.lit("md5").alias("kind"), F.md5(octets).alias("value")), F.struct(F.lit("sha256").alias("kind"), F.sha2(octets, 256).alias("value")))
        digests = files.select("path", F.octet_length(octets).alias("n"), F.explode(each).alias("d")).select("path", "n", "d.kind", "d.value")
        out.append(digests.join(_bounded(table), ["kind", "value"]).where("size is null or size = n").select("path", "name", F.lit("hash").alias("what")))
    if bodies:
        met = files.select("path", octets.alias("content")).mapInArrow(_bodies(spark.sparkContext.broadcast(bodies)), "path string, name string")
        out.append(met.select("path", "name", F.lit("body").alias("what")))
    rows = out[0].union(out[1]) if len(out) == 2 else out[0] if out else spark.createDataFrame([], "path string, name string, what string")
    return rows.select(*_finding(F.concat(F.lit("clamav:"), F.col("name")), F.concat(F.lit('ClamAV signature "'), F.col("name"), F.lit('" matched ('), F.col("what"), F.lit(")")), F.lit("critical"), F.lit("CWE-506"), 1))
