"""Schemas of the stored tables and of rows in flight."""

from __future__ import annotations

FINDING = "rule string, path string, line int, col int, snippet string, severity string, cwe string, cve string"
FINDING_COLUMNS = tuple(part.split()[0] for part in FINDING.split(", "))
SYMBOLS = "array<struct<kind:string,name:string,line:int>>"
CALLS = "array<struct<callee:string,line:int,arg_idents:array<string>,arg_calls:array<string>>>"
ASSIGNS = "array<struct<target:string,line:int,rhs_idents:array<string>,rhs_calls:array<string>>>"

#: Record tables, by name.
TABLES = {
    "file": "hash string, path string, abs string, host string, mode int, uid int, gid int, user string, group string, size bigint, mtime string",
    "finding": f"finding_id string, file_hash string, {FINDING}, cwe_name string",
    "ast": f"hash string, lang string, symbols {SYMBOLS}",
    "indicators": "hash string, emails array<string>, domains array<string>, ips array<string>, urls array<string>, hashes array<string>",
    "scan": "scan_id string, name string, root string, host string, started_at bigint, files bigint, matches bigint, ruleset string",
    "rule": "rule_id string, name string, pattern string, description string, severity string, cwe string, cve string",
    "dataset": "name string, rules bigint",
    "cwe": "id string, name string, abstraction string, status string, description string",
    "event": "finding_id string, category string, action string, signature string, severity string, src string",
    "feed": "name string, url string",
    "plugin_setting": "plugin string, key string, setting_value string",
    "path_model": "name string, model string",
    "source": "name string",
}
#: Edge tables that are kept; the other edges are keys of records or views.
EDGES = {
    "includes": "scan_id string, hash string",
    "contained_in": "inner string, container string",
    "from_dataset": "rule_id string, dataset string",
}
