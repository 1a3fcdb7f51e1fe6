"""Dangerous calls and untrusted data that reaches them, over syntax facts (symbols, calls, assigns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.tables import SINKS, SOURCE_LAST, SOURCE_PARTS, TAINT_SINKS, Sink


def sink_of(callee: Column, sinks: tuple[Sink, ...] = SINKS) -> Column:
    """(rule, severity, cwe, what) of a call; null if it isn't a sink."""
    last = F.element_at(F.split(callee, r"\."), -1)
    out = None
    for s in sinks:
        met = F.lit(False)
        for name in s.names:
            met = met | {
                "contains": lambda n: callee.contains(n),
                "equals": lambda n: callee == n,
                "iequals": lambda n: F.lower(callee) == n,
                "last": lambda n: last == n,
                "last_prefix": lambda n: last.startswith(n),
                "prefix_loads": lambda n: callee.startswith(n) & (last == "loads"),
            }[s.how](name)
        said = F.struct(F.lit(s.rule).alias("rule"), F.lit(s.severity).alias("severity"), F.lit(s.cwe).alias("cwe"), F.lit(s.what).alias("what"))
        out = F.when(met, said) if out is None else out.when(met, said)
    return out


def is_source(callee: Column) -> Column:
    """Whether a call brings in untrusted data."""
    out = F.element_at(F.split(callee, r"\."), -1).isin(*SOURCE_LAST)
    for part in SOURCE_PARTS:
        out = out | callee.contains(part)
    return out


def dangerous_calls(ast: DataFrame) -> DataFrame:
    """Findings of (path, symbols) rows: a row per call of a sink."""
    rows = ast.select("path", F.posexplode("symbols").alias("rule_ord", "s")).where("s.kind = 'call'").withColumn("k", sink_of(F.col("s.name"))).where("k is not null")
    return rows.select(F.col("k.rule").alias("rule"), "path", F.col("s.line").alias("line"), F.lit(1).alias("col"), F.concat(F.lit("call to "), F.col("s.name"), F.lit(" ("), F.col("k.what"), F.lit(")")).alias("snippet"), F.col("k.severity").alias("severity"), F.col("k.cwe").alias("cwe"), F.lit(None).cast("string").alias("cve"), "rule_ord")


def tainted(assigns: str = "assigns") -> Column:
    """Names that hold untrusted data after one pass over the assignments in order; none is ever cleared."""
    start = F.array().cast("array<string>")

    def step(held: Column, a: Column) -> Column:
        dirty = F.exists(a["rhs_calls"], is_source) | F.arrays_overlap(a["rhs_idents"], held)
        return F.when(F.coalesce(dirty, F.lit(False)), F.array_union(held, F.array(a["target"]))).otherwise(held)

    return F.aggregate(assigns, start, step)


def taint_flows(ast: DataFrame) -> DataFrame:
    """Findings of (path, calls, assigns) rows: sinks that are given a tainted name, or a source directly."""
    rows = ast.withColumn("held", tainted()).select("path", "held", F.posexplode("calls").alias("rule_ord", "c")).withColumn("k", sink_of(F.col("c.callee"), TAINT_SINKS)).where("k is not null")
    direct = F.exists("c.arg_calls", is_source)
    by_name = F.coalesce(F.arrays_overlap("c.arg_idents", "held"), F.lit(False))
    how = F.when(direct, "untrusted input passed directly ").otherwise("tainted variable reaches ")
    return rows.where(direct | by_name).select(F.col("k.rule").alias("rule"), "path", F.col("c.line").alias("line"), F.lit(1).alias("col"), F.concat(how, F.col("c.callee"), F.lit(" ("), F.col("k.what"), F.lit(")")).alias("snippet"), F.col("k.severity").alias("severity"), F.col("k.cwe").alias("cwe"), F.lit(None).cast("string").alias("cve"), "rule_ord")
