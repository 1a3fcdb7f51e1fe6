"""The stored graph: upserts, closures, neighbours, collection of garbage, snapshots. Edges are (rel, src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels of containers inside containers; fixed value.
DEPTH = 8


def newest(rows: DataFrame, key: str | list[str], order: Column | str) -> DataFrame:
    """One row per key: the last by ``order`` (partial aggregation, no window over a key's rows)."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def latest_scan(scans: DataFrame, name: str | None = None) -> DataFrame:
    """The newest scan (of a name); of equal times the last id."""
    rows = scans if name is None else scans.where(F.col("name") == name)
    return rows.orderBy(F.desc("started_at"), F.desc("scan_id")).limit(1)


def runs(scans: DataFrame) -> DataFrame:
    return scans.orderBy(F.desc("started_at"), F.desc("scan_id"))


def unchanged(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """``listing`` with the previous hash and whether size and stamp agree; a file without a stamp counts as changed."""
    before = previous.select("abs", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("previous_hash"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & (F.col("mtime") != "")
    return listing.join(before, "abs", "left").select(*[listing[c] for c in listing.columns], "previous_hash", F.coalesce(same, F.lit(False)).alias("unchanged"))


def closure(contained_in: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(inner, container) pairs, direct and through other containers, up to ``depth`` levels; cycles end there."""
    step = contained_in.select("inner", "container").distinct()
    reached, edge = step, step
    for _ in range(depth - 1):
        edge = edge.join(step.select(F.col("inner").alias("container"), F.col("container").alias("_up")), "container").select("inner", F.col("_up").alias("container")).distinct()
        reached = reached.union(edge)
    return reached.distinct()


def label(kind: str) -> Column:
    """How a record of a kind is called in listings."""
    if kind == "finding":
        return F.concat("rule", F.lit(" @ "), "path", F.lit(":"), "line")
    if kind == "ast":
        return F.concat("lang", F.lit(" ast"))
    if kind == "indicators":
        return F.concat(F.lit("indicators ("), *[x for c, sign in (("emails", "e "), ("domains", "d "), ("ips", "ip "), ("urls", "url "), ("hashes", "h)")) for x in (F.size(c), F.lit(sign))])
    if kind == "event":
        return F.concat("category", F.lit("/"), "action", F.lit(" "), "signature")
    return F.col({"file": "path", "scan": "root"}.get(kind, "name"))


def findings_graph(findings: DataFrame, files: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (rel, src, dst): findings in files, flagged by rules of their name."""
    f = F.concat(F.lit("finding:"), F.col("finding_id"))
    nodes = findings.select(f.alias("id"), F.lit("finding").alias("kind"), label("finding").alias("label"))
    nodes = nodes.union(files.select(F.concat(F.lit("file:"), F.col("hash")), F.lit("file"), F.col("path"))).union(rules.select(F.concat(F.lit("rule:"), F.col("name")), F.lit("rule"), F.col("name")))
    edges = findings.select(F.lit("in_file").alias("rel"), f.alias("src"), F.concat(F.lit("file:"), F.col("file_hash")).alias("dst"))
    flagged = findings.join(rules.select(F.col("name").alias("rule")).distinct(), "rule", "left_semi").select(F.lit("flagged_by"), f, F.concat(F.lit("rule:"), F.col("rule")))
    return nodes.dropDuplicates(["id"]), edges.union(flagged)


def record_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """(rel, src, dst) of the relations between stored records, those of ``findings_graph`` aside: a file's syntax and indicators, a finding's
    event and syntax, a rule's rule set, a rule set's source, a scan's files and the containers of files."""
    of = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column))
    edge = lambda rows, rel, src, dst: rows.select(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"))
    at = tables["finding"].join(tables["ast"].select(F.col("hash").alias("file_hash")).distinct(), "file_hash", "left_semi")
    parts = [
        edge(tables["ast"], "has_ast", of("file", "hash"), of("ast", "hash")),
        edge(tables["indicators"], "has_indicators", of("file", "hash"), of("indicators", "hash")),
        edge(tables["event"], "has_event", of("finding", "finding_id"), of("event", "finding_id")),
        edge(at, "at_ast", of("finding", "finding_id"), of("ast", "file_hash")),
        edge(tables["from_dataset"].join(tables["rule"].select("rule_id", "name"), "rule_id"), "from_dataset", of("rule", "name"), of("dataset", "dataset")),
        edge(tables["dataset"].join(tables["source"].select("name"), "name"), "from_source", of("dataset", "name"), of("source", "name")),
        edge(tables["includes"], "includes", of("scan", "scan_id"), of("file", "hash")),
        edge(tables["contained_in"], "contained_in", of("file", "inner"), of("file", "container")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rel, direction, other, label) of every edge at the asked ids, both ways."""
    out = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), "rel", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    into = edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("id"), "rel", F.lit("in").alias("direction"), F.col("src").alias("other"))
    label = nodes.select(F.col("id").alias("other"), "label")
    return out.union(into).join(label, "other", "left").select("id", "rel", "direction", "other", "label")


def collect_garbage(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the newest scan only, and what it includes: other scans, their files, and the findings, events, syntax
    facts, indicators and containments of those files go. Without a scan all stays."""
    keep = latest_scan(tables["scan"]).select("scan_id")
    none = keep.limit(1).count() == 0
    if none:
        return dict(tables)
    out = dict(tables)
    out["scan"] = tables["scan"].join(keep, "scan_id", "left_semi")
    out["includes"] = tables["includes"].join(keep, "scan_id", "left_semi")
    live = out["includes"].select("hash").distinct()
    for name in ("file", "ast", "indicators"):
        if name in tables:
            out[name] = tables[name].join(live, "hash", "left_semi")
    out["finding"] = tables["finding"].join(live.withColumnRenamed("hash", "file_hash"), "file_hash", "left_semi")
    if "event" in tables:
        out["event"] = tables["event"].join(out["finding"].select("finding_id"), "finding_id", "left_semi")
    if "contained_in" in tables:
        out["contained_in"] = tables["contained_in"].join(live.withColumnRenamed("hash", "inner"), "inner", "left_semi").join(live.withColumnRenamed("hash", "container"), "container", "left_semi")
    return out


def removed(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, int]:
    """Rows that went, by table."""
    return {name: before[name].count() - after[name].count() for name in before}


def without_run(scans: DataFrame, includes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Scans and inclusions without the runs of a name; findings stay."""
    gone = scans.where(F.col("name") == name).select("scan_id")
    return scans.join(gone, "scan_id", "left_anti"), includes.join(gone, "scan_id", "left_anti")


def replaced(findings: DataFrame, fresh: DataFrame, scanned: DataFrame) -> DataFrame:
    """Findings with those of the scanned hashes taken out and the fresh ones put in."""
    return findings.join(scanned.select(F.col("hash").alias("file_hash")).distinct(), "file_hash", "left_anti").unionByName(fresh)


def set_field(table: DataFrame, key: str, value: str, field: str, new: object) -> tuple[DataFrame, DataFrame]:
    """The table with one field of one record set, and the old value (for undo)."""
    old = table.where(F.col(key) == value).select(F.col(field).alias("old"))
    return table.withColumn(field, F.when(F.col(key) == value, F.lit(new).cast(table.schema[field].dataType)).otherwise(F.col(field))), old


def record(tables: dict[str, DataFrame], keys: dict[str, str], ident: str) -> DataFrame:
    """One row, json: the record of ``table:key``."""
    name, _, key = ident.partition(":")
    return tables[name].where(F.col(keys[name]) == key).select(F.to_json(F.struct("*")).alias("json"))


#: What an export says of itself.
EXPORT_VERSION, NAMESPACE = 1, "siftstone"


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, json): a head with version and namespace (its table is empty), then a row per record of every table."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([("", f'{{"version":{EXPORT_VERSION},"namespace":"{NAMESPACE}"}}')], "table string, json string")
    for name in sorted(tables):
        rows = tables[name].select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("json"))
        out = out.union(rows)
    return out
