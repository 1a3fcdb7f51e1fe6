"""One object for it all: scan, search, analyse, report, graph, collect garbage, train, evaluate.

Tables are Parquet folders under ``store``, each version in a folder of its own; a small pointer file names the current one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftstone import reports, schema
from siftstone.functions.tables import SECRETS, Rule
from siftstone.model import classifier
from siftstone.operators import catalogs, code, detect, graph, indicators, ranking, rollups, search, supply
from siftstone.operators.yara import yara
from siftstone.reports import rows as report_rows
from siftstone.session import durable, ship
from siftstone.sources import containers, feeds, syntax, tree

_TABLES = schema.TABLES | schema.EDGES
_KEYS = {"file": "hash", "finding": "finding_id", "ast": "hash", "indicators": "hash", "scan": "scan_id", "rule": "rule_id", "dataset": "name", "cwe": "id", "event": "finding_id", "feed": "name", "path_model": "name"}
_SETTINGS = {"cwe", "feed", "plugin_setting", "path_model"}
#: Files that a time budget's first piece takes; each piece is twice the one before.
FIRST_SLICE = 256


class Store:
    """Named tables in a folder; ``put`` writes a new version and then moves the pointer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/current"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self, name: str) -> str | None:
        fs, path = self._fs()
        at = path(self._pointer(name))
        if not fs.exists(at):
            return None
        found = [s.getPath().getName() for s in fs.listStatus(at)]
        return max(found) if found else None

    def get(self, name: str) -> DataFrame:
        version = self.version(name)
        if version is None:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(StructType.fromDDL(_TABLES[name])).parquet(f"{self.root}/{name}/{version}")

    def put(self, name: str, rows: DataFrame) -> None:
        """Rows in place of the table. The old version stays until the next one, for readers that are under way."""
        fs, path = self._fs()
        before = self.version(name)
        version = f"{int(before.split('-')[0]) + 1 if before else 1:09d}-{uuid.uuid4().hex[:8]}"
        columns = [f.name for f in StructType.fromDDL(_TABLES[name])]
        rows.select(*columns).write.parquet(f"{self.root}/{name}/{version}")
        fs.create(path(f"{self._pointer(name)}/{version}")).close()
        for status in fs.listStatus(path(f"{self.root}/{name}")):
            folder = status.getPath().getName()
            if folder not in ("current", version, before):
                fs.delete(status.getPath(), True)

    def add(self, name: str, rows: DataFrame) -> None:
        self.put(name, self.get(name).unionByName(rows.select(*self.get(name).columns)))


class Engine:
    def __init__(self, spark: SparkSession, store: str) -> None:
        self.spark, self.store = ship(spark), Store(spark, store)

    # scanning

    def rules(self) -> list[Rule]:
        """The built-in rules and those of the rule sets in the store."""
        held = catalogs.rules_of(self.store.get("rule"), self.store.get("from_dataset")).orderBy("name", "pattern").collect()  # configuration
        return [*SECRETS, *[Rule(r["name"], r["pattern"], r["severity"], r["cwe"], r["description"], r["cve"]) for r in held]]

    def detect(self, files: DataFrame, rules: list[Rule], show: bool = False, clamav: list[str] | None = None) -> DataFrame:
        """Findings of (path, hash, content) rows: text detectors on files without NULs, signatures on all."""
        text = files.where(~indicators.is_binary(F.col("content"))).select("path", tree.text().alias("text"))
        iocs = indicators.ioc_table(feeds.rule_table(self.spark, rules))
        found = indicators.indicators(text)
        facts = syntax.syntax(text)
        parts = [detect.regex_rules(text, rules, show), detect.personal(text), detect.log_events(text), code.dangerous_calls(facts), code.taint_flows(facts)]
        plain = [supply.supply_chain(text), indicators.typosquat_domains(found)]
        if any(feeds_scheme(r) for r in rules):
            plain += [indicators.hash_iocs(text, iocs), indicators.network_iocs(found, iocs), indicators.breached(found, iocs)]
        blocks = [r.pattern.split(":", 1)[1] for r in rules if r.pattern.startswith("yara:")]
        if blocks:
            plain.append(yara(files, blocks))
        if clamav:
            plain.append(indicators.clamav(files, clamav))
        parts += [p.withColumn("rule_ord", F.lit(1000)) for p in plain]
        columns = [*schema.FINDING_COLUMNS, "rule_ord"]
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])

    def scan(self, root: str, name: str | None = None, budget: str | None = None, ignore: bool = False, show: bool = False, full: bool = False) -> dict:
        """Scans a tree: files that size and stamp say are unchanged keep their findings, unless the rules have changed.

        With a budget, files are ranked by the trained model (or the directory prior) and the head of the ranking is scanned.
        """
        started, rules, ruleset = self._begin()
        last = graph.latest_scan(self.store.get("scan")).collect()
        previous = self.store.get("file").where(F.lit(not full and (not last or last[0]["ruleset"] in ("", ruleset))))
        listed = durable(graph.unchanged(tree.listing(self.spark, root, ignore=ignore), previous))
        total, asked = listed.count(), None
        if budget is not None:
            asked = ranking.parse_budget(budget)
            scored = self._scored(listed.select("abs", "path", "size", (~F.col("unchanged")).alias("changed")))
            listed = durable(listed.join(ranking.cut(ranking.ranked(scored), asked).select("path", "rk"), "path"))
        reads, parts = [], []
        for part in self._slices(listed, asked, started):
            reads.append(durable(tree.contents(part.where("not unchanged"))))
            parts.append(self._unpacked(reads[-1].where("status = 'scanned'"), rules, show))
            done = part if len(reads) == 1 else done.unionByName(part)
        read = reduce(DataFrame.unionByName, reads)
        unpacked, found = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
        own = read.where("hash is not null").select("hash", "path", "abs", "host", "mode", "uid", "gid", F.lit("").alias("user"), F.lit("").alias("group"), "size", "mtime")
        counts = {"unreadable": read.where("status = 'unreadable'").count(), "oversize": read.where("status = 'oversize'").count(), "skipped": total - done.count()}
        return self._record(own, unpacked, found, done.where("unchanged"), read.count(), counts, total, (name, root, "", started, ruleset))

    def scan_rows(self, rows: DataFrame, root: str, name: str | None = None, host: str = "", show: bool = False) -> dict:
        """Scans (path, content) rows of any source: processes, banners, pages, or files of a remote file system (``remote.files``). Null contents count as unreadable."""
        started, rules, ruleset = self._begin()
        rows = durable(rows.select("path", F.col("content").cast("binary").alias("content")))
        files = rows.where("content is not null")
        unpacked, found = self._unpacked(files, rules, show)
        empty = [F.lit(0).alias(c) for c in ("mode", "uid", "gid")]
        own = files.select(F.sha2("content", 256).alias("hash"), "path", F.col("path").alias("abs"), F.lit(host).alias("host"), *empty, F.lit("").alias("user"), F.lit("").alias("group"), F.octet_length("content").cast("long").alias("size"), F.lit("").alias("mtime"))
        n, total = files.count(), rows.count()
        none = self.spark.createDataFrame([], "previous_hash string")
        return self._record(own, unpacked, found, none, total, {"unreadable": total - n, "oversize": 0, "skipped": 0}, total, (name, root, host, started, ruleset))

    def _begin(self) -> tuple[int, list[Rule], str]:
        started, rules = int(time.time() * 1000), self.rules()
        return started, rules, rollups.fingerprint(feeds.rule_table(self.spark, rules)).first()["ruleset"]

    def _slices(self, listed: DataFrame, asked: ranking.Budget | None, started: int):
        """The files to scan; under a time budget growing pieces of the ranking, until the time is over."""
        if asked is None or asked.kind != "time":
            yield listed
            return
        at, size, most = 0, FIRST_SLICE, listed.agg(F.max("rk")).first()[0] or 0
        while at == 0 or (at < most and time.time() - started / 1000 < asked.amount):
            yield listed.where(F.col("rk").between(at + 1, at + size))
            at, size = at + size, size * 2

    def _unpacked(self, files: DataFrame, rules: list[Rule], show: bool) -> tuple[DataFrame, DataFrame]:
        """What is in the files, containers opened, and the findings in it."""
        unpacked = durable(containers.expand(files.select("path", "content")).withColumn("hash", F.sha2("content", 256)))
        by_path = unpacked.select("path", F.col("hash").alias("file_hash")).dropDuplicates(["path"])
        found = self.detect(unpacked, rules, show).join(by_path, "path")
        return unpacked, durable(found.withColumn("finding_id", F.expr("uuid()")).withColumn("cwe_name", F.lit(None).cast("string")))

    def _record(self, own: DataFrame, unpacked: DataFrame, found: DataFrame, same: DataFrame, read: int, counts: dict, total: int, run: tuple) -> dict:
        """Stores a scan: files, findings, syntax, indicators, containers and the run itself; returns its summary."""
        name, root, host, started, ruleset = run
        inner = unpacked.where("depth > 0").select("hash", "path", F.col("path").alias("abs"), F.lit(host).alias("host"), F.lit(0).alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit("").alias("user"), F.lit("").alias("group"), F.octet_length("content").cast("long").alias("size"), F.lit("").alias("mtime"))
        latest = graph.newest(own.unionByName(inner), "hash", F.struct("path"))
        held = unpacked.where("depth > 0").select(F.col("hash").alias("inner"), F.col("container_hash").alias("container")).distinct()
        text = unpacked.where(~indicators.is_binary(F.col("content"))).select("path", "hash", tree.text().alias("text"))
        facts, marks = syntax.syntax(text), indicators.indicators(text)

        contained = self.store.get("contained_in").union(held).distinct()
        kept = same.select(F.col("previous_hash").alias("hash")).distinct()
        nested = graph.closure(contained).join(kept.withColumnRenamed("hash", "container"), "container", "left_semi").select(F.col("inner").alias("hash"))
        scan_id = uuid.uuid4().hex
        live = kept.union(nested).union(latest.select("hash")).distinct().withColumn("scan_id", F.lit(scan_id))
        summary = {"scan_id": scan_id, "files": read + same.count(), "unchanged": kept.union(nested).distinct().count(), "findings": found.count(), **counts}
        summary["coverage"] = (total - summary["skipped"]) / total if total else 1.0

        hashes = latest.select("hash")
        self.store.put("finding", durable(graph.replaced(self.store.get("finding"), found.select(*self.store.get("finding").columns), hashes)))
        for table, rows in (("file", latest), ("ast", graph.newest(facts.select("hash", "lang", "symbols"), "hash", F.col("lang"))), ("indicators", marks.select("hash", "emails", "domains", "ips", "urls", "hashes").dropDuplicates(["hash"]))):
            self.store.put(table, durable(catalogs.put(self.store.get(table), rows, ["hash"])))
        self.store.put("contained_in", durable(contained))
        self.store.add("includes", live.select("scan_id", "hash"))
        called = name or time.strftime("%Y-%m-%dT%H-%M-%S", time.gmtime(started / 1000))
        self.store.add("scan", self.spark.createDataFrame([(scan_id, called, root, host, started, summary["files"], summary["findings"], ruleset)], _TABLES["scan"]))
        return summary

    def _scored(self, candidates: DataFrame) -> DataFrame:
        """Candidates by what the model says of their absolute path; without a model by how often their directory has had findings."""
        model = self.model()
        rows = candidates.select(F.col("abs").alias("path"), F.col("path").alias("_walked"), "size", "changed")
        if model is not None:
            scored = classifier.score(rows, model)
        else:
            known = self.training_paths()
            scored = ranking.prior_scores(rows, ranking.directory_prior(known), known)
        return scored.select(F.col("_walked").alias("path"), "size", "changed", "score")

    # reading

    def search(self, query: str = "", limit: int | None = None) -> DataFrame:
        """Findings that a query selects, worst first; ``limit`` shows the first only."""
        rows = search.search(self.store.get("finding"), query, self.store.get("scan"), self.store.get("includes"))
        return rows if limit is None else rows.limit(limit)

    def analyse(self, query: str = "", most: int = reports.LISTED) -> reports.Analysis:
        totals = rollups.totals(self.store.get("file"), self.store.get("scan"), self.store.get("finding")).first()
        return reports.analysis(self.search(query), totals["files"], totals["scans"], most)

    def report(self, kind: str = "text", query: str = "", most: int = reports.LISTED) -> str | bytes:
        """A report that lists ``most`` findings and says how many it leaves out."""
        return reports.render(self.analyse(query, most), kind)

    def write_report(self, kind: str, folder: str, query: str = "") -> None:
        """Every finding as a row of a report, written from the executors."""
        report_rows.write(self.search(query), kind, folder)

    def gate(self, least: str, root: str) -> int:
        """Findings at or over a severity under a root (by absolute path where the file has one)."""
        place = self.store.get("file").select(F.col("hash").alias("file_hash"), "abs")
        return search.breaching(self.store.get("finding").join(place, "file_hash", "left").withColumn("abs", F.coalesce("abs", "path")), least, root, "abs").count()

    def graph(self) -> tuple[DataFrame, DataFrame]:
        rules = feeds.rule_table(self.spark, self.rules()).select("name").distinct()
        return graph.findings_graph(self.store.get("finding"), self.store.get("file"), rules)

    def neighbours(self, ident: str) -> DataFrame:
        nodes, edges = self.graph()
        tables = ("ast", "indicators", "event", "finding", "from_dataset", "rule", "dataset", "source", "includes", "contained_in")
        more = graph.record_edges({name: self.store.get(name) for name in tables})
        return graph.neighbours(edges.union(more), nodes, self.spark.createDataFrame([(ident,)], "id string"))

    def record(self, ident: str) -> str | None:
        found = graph.record({k: self.store.get(k) for k in _KEYS}, _KEYS, ident).first()
        return found["json"] if found else None

    def export(self) -> DataFrame:
        """A head, then every record of every table but settings, feeds and models."""
        return graph.snapshot({name: self.store.get(name) for name in _TABLES if name not in _SETTINGS})

    def records(self, table: str, limit: int = 50) -> DataFrame:
        label = graph.label(table) if table not in ("cwe", "feed", "path_model") else F.col(_KEYS[table])
        return search.records(self.store.get(table), _KEYS[table], label, limit)

    # changing

    def collect_garbage(self) -> dict[str, int]:
        names = ("scan", "includes", "file", "ast", "indicators", "finding", "event", "contained_in")
        before = {n: self.store.get(n) for n in names}
        after = {n: durable(t) for n, t in graph.collect_garbage(before).items()}
        gone = graph.removed(before, after)
        for n, t in after.items():
            self.store.put(n, t)
        return gone

    def remove_run(self, name: str) -> None:
        scans, includes = graph.without_run(self.store.get("scan"), self.store.get("includes"), name)
        scans, includes = durable(scans), durable(includes)
        self.store.put("scan", scans)
        self.store.put("includes", includes)

    def set_field(self, table: str, ident: str, field: str, value: object) -> object:
        """Sets a field of a record; returns the old value."""
        rows, old = graph.set_field(self.store.get(table), _KEYS[table], ident, field, value)
        before = old.first()
        self.store.put(table, durable(rows))
        return before["old"] if before else None

    def normalise(self) -> DataFrame:
        """Writes an event per finding; returns events by category."""
        rows = durable(catalogs.put_events(self.store.get("event"), rollups.events(self.store.get("finding"))))
        self.store.put("event", rows)
        return rollups.event_counts(rows)

    def annotate(self) -> None:
        rows = rollups.annotated(self.store.get("finding").drop("cwe_name"), self.store.get("cwe"))
        self.store.put("finding", durable(rows))

    def add_rules(self, name: str, rules: list[Rule]) -> None:
        fresh = feeds.rule_table(self.spark, rules).drop("rule_ord").withColumn("rule_id", F.lit(None).cast("string"))
        held = catalogs.put_dataset(self.store.get("rule"), self.store.get("from_dataset"), self.store.get("dataset"), name, fresh.drop("rule_id"))
        for table, rows in zip(("rule", "from_dataset", "dataset"), map(durable, held), strict=True):
            self.store.put(table, rows)

    def remove_rules(self, name: str) -> None:
        edges, datasets = catalogs.drop_dataset(self.store.get("from_dataset"), self.store.get("dataset"), name)
        edges, datasets = durable(edges), durable(datasets)
        self.store.put("from_dataset", edges)
        self.store.put("dataset", datasets)

    def datasets(self) -> DataFrame:
        return catalogs.listed(self.store.get("dataset"))

    def dataset_rules(self, name: str) -> DataFrame:
        return catalogs.rules_of(self.store.get("rule"), self.store.get("from_dataset"), name)

    def _set(self, table: str, keys: list[str], row: tuple) -> None:
        self.store.put(table, durable(catalogs.put(self.store.get(table), self.spark.createDataFrame([row], _TABLES[table]), keys)))

    def _unset(self, table: str, name: str) -> None:
        self.store.put(table, durable(catalogs.drop(self.store.get(table), name=name)))

    def add_feed(self, name: str, url: str) -> None:
        self._set("feed", ["name"], (name, url))

    def feeds(self) -> DataFrame:
        return catalogs.listed(self.store.get("feed"))

    def remove_feed(self, name: str) -> None:
        self._unset("feed", name)

    def set_plugin(self, plugin: str, key: str, value: str) -> None:
        self._set("plugin_setting", ["plugin", "key"], (plugin, key, value))

    def plugin_settings(self, plugin: str) -> dict[str, str]:
        return {r["key"]: r["setting_value"] for r in self.store.get("plugin_setting").where(F.col("plugin") == plugin).collect()}

    def models(self) -> DataFrame:
        return catalogs.listed(self.store.get("path_model").select("name"))

    def remove_model(self, name: str) -> None:
        self._unset("path_model", name)

    def load_weaknesses(self, text: str) -> int:
        rows = self.spark.createDataFrame(feeds.weaknesses(text), _TABLES["cwe"])
        self.store.put("cwe", rows)
        return rows.count()

    # the path model

    def training_paths(self) -> DataFrame:
        """(path, has_finding) of every stored file, by absolute path."""
        flagged = self.store.get("finding").select(F.col("file_hash").alias("hash"), F.lit(True).alias("f")).distinct()
        return self.store.get("file").join(flagged, "hash", "left").select(F.coalesce(F.when(F.col("abs") != "", F.col("abs")), F.col("path")).alias("path"), F.coalesce("f", F.lit(False)).alias("has_finding"))

    def train(self, name: str = "default", **options) -> None:
        model = classifier.train(self.training_paths(), **options)
        fresh = self.spark.createDataFrame([(name, model.to_json())], _TABLES["path_model"])
        self.store.put("path_model", durable(catalogs.put(self.store.get("path_model"), fresh, ["name"])))

    def model(self, name: str = "default") -> classifier.PathModel | None:
        found = self.store.get("path_model").where(F.col("name") == name).first()
        return classifier.PathModel.from_json(found["model"]) if found else None

    def evaluate(self, holdout: float = 0.3, **options) -> dict | None:
        return classifier.evaluate(self.training_paths(), holdout, **options)


def feeds_scheme(rule: Rule) -> str | None:
    from siftstone.functions.schemes import scheme

    return scheme(rule.pattern)


Detector = Callable[[DataFrame], DataFrame]
