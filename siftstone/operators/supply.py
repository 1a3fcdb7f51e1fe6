"""Dependencies of package manifests: known malware, look-alikes, cleartext sources and install hooks."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import matching as m
from siftstone.functions import names
from siftstone.functions.tables import HOOK_FLAGS, MALWARE, NOT_TYPOSQUATS, POPULAR

_HOOKS = ("preinstall", "install", "postinstall")
_TABLES = ("dependencies", "devDependencies", "optionalDependencies")


def manifest_kind(path: Column) -> Column:
    """npm, pypi or cargo by file name; null for other files."""
    leaf = m.leaf(path)
    return F.when(leaf == "package.json", "npm").when(leaf.rlike(r"^requirements.*\.txt$"), "pypi").when(leaf == "Cargo.toml", "cargo")


def _requirements(text: Column) -> Column:
    lines = F.filter(F.transform(m.lines(text), F.trim), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.get(F.split(x, r"[=<>~!;\[ ]"), 0))), lambda x: x != "")


def _cargo(texts: pd.Series) -> pd.Series:
    def names_of(text):
        try:
            value = tomllib.loads(text)
        except Exception:
            return None
        return [k for t in ("dependencies", "dev-dependencies", "build-dependencies") if isinstance(value.get(t), dict) for k in sorted(value[t])]

    return texts.map(lambda t: None if t is None else names_of(t))


def _npm(texts: pd.Series) -> pd.DataFrame:
    def read(text):
        try:
            value = json.loads(text)
        except Exception:
            return None, None
        if not isinstance(value, dict):
            return [], []
        deps = [k for t in _TABLES if isinstance(value.get(t), dict) for k in sorted(value[t])]
        scripts = value.get("scripts") if isinstance(value.get("scripts"), dict) else {}
        return deps, [{"hook": h, "script": scripts[h]} for h in _HOOKS if isinstance(scripts.get(h), str)]

    return pd.DataFrame([read(t) if t is not None else (None, None) for t in texts], columns=["deps", "hooks"])


def dependencies(files: DataFrame) -> DataFrame:
    """(path, text, kind, deps, hooks) of manifests; deps is null where a manifest can't be read."""
    rows = files.withColumn("kind", manifest_kind(F.col("path"))).where("kind is not null")
    none = F.lit(None).cast("array<struct<hook:string,script:string>>")
    read_npm, read_cargo = F.pandas_udf(_npm, "struct<deps:array<string>,hooks:array<struct<hook:string,script:string>>>"), F.pandas_udf(_cargo, "array<string>")
    npm = rows.where("kind = 'npm'").withColumn("_n", read_npm("text")).select("path", "text", "kind", "_n.deps", "_n.hooks")
    pypi = rows.where("kind = 'pypi'").select("path", "text", "kind", _requirements(F.col("text")).alias("deps"), none.alias("hooks"))
    cargo = rows.where("kind = 'cargo'").select("path", "text", "kind", read_cargo("text").alias("deps"), none.alias("hooks"))
    return npm.unionByName(pypi).unionByName(cargo)


def imitated(name: Column) -> Column:
    """The popular package that a name passes for; null for none, and for popular or known names."""
    popular = F.array(*map(F.lit, POPULAR))
    near = F.get(F.filter(popular, lambda p: names.impersonates(name, p)), 0)
    return F.when(~F.array_contains(popular, name) & ~name.isin(*NOT_TYPOSQUATS), near)


def judge(deps: DataFrame) -> DataFrame:
    """Findings of (path, text, deps, hooks) rows."""
    q = F.lit('"')
    lines = m.lines("text")
    dep = deps.where("deps is not null").select("path", "text", F.posexplode("deps").alias("ord", "dep")).withColumn("like", imitated(F.col("dep")))
    bad = F.col("dep").isin(*MALWARE)
    dep = dep.where(bad | F.col("like").isNotNull())
    first = _line_of(lines, F.col("dep"))
    named = dep.select(
        F.when(bad, "supply-chain-known-malware").otherwise("supply-chain-typosquat").alias("rule"), "path", first.alias("line"), F.lit(1).alias("col"),
        F.when(bad, F.concat(F.lit("dependency "), q, F.col("dep"), q, F.lit(" is a known malicious package"))).otherwise(F.concat(F.lit("dependency "), q, F.col("dep"), q, F.lit(" is one edit away from "), q, F.col("like"), q, F.lit(" (possible typosquat)"))).alias("snippet"),
        F.when(bad, "critical").otherwise("high").alias("severity"), F.when(bad, "CWE-506").otherwise("CWE-829").alias("cwe"), F.lit(None).cast("string").alias("cve"),
    )
    plain = deps.where("deps is not null").where(F.exists(lines, lambda x: x.contains("http://") & ~F.ltrim(x).startswith("#")))
    insecure = plain.select(F.lit("supply-chain-insecure-source").alias("rule"), "path", _line_of(lines, F.lit("http://")).alias("line"), F.lit(1).alias("col"), F.lit("dependency source fetched over cleartext http").alias("snippet"), F.lit("medium").alias("severity"), F.lit("CWE-829").alias("cwe"), F.lit(None).cast("string").alias("cve"))
    hook = deps.select("path", "text", F.explode("hooks").alias("h")).select("path", "text", "h.*")
    flagged = F.exists(F.array(*map(F.lit, HOOK_FLAGS)), lambda f: F.contains(F.col("script"), f))
    said = F.concat(F.col("hook"), F.when(flagged, " hook downloads or evals code: ").otherwise(" hook runs code on install: "), q, F.col("script"), q)
    hooks = hook.select(F.lit("supply-chain-install-hook").alias("rule"), "path", _line_of(lines, F.col("hook")).alias("line"), F.lit(1).alias("col"), said.alias("snippet"), F.when(flagged, "critical").otherwise("medium").alias("severity"), F.lit("CWE-94").alias("cwe"), F.lit(None).cast("string").alias("cve"))
    return named.unionByName(insecure).unionByName(hooks)


def _line_of(lines: Column, needle: Column) -> Column:
    """1-based line in which the text first occurs; 1 if in none."""
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, needle), i + 1)), lambda i: i.isNotNull()), 0)
    return F.coalesce(at, F.lit(1)).cast("int")


def supply_chain(files: DataFrame) -> DataFrame:
    """Findings of package.json, requirements*.txt and Cargo.toml files."""
    return judge(dependencies(files))
