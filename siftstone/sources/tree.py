"""Files of a directory tree as rows: what stat says first, contents only of those that are asked for."""

from __future__ import annotations

import hashlib
import os
import re
import stat as modes
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftstone.functions.tables import ALWAYS_SKIPPED, SKIP_DIRS

#: Larger files are recorded, not read; fixed value.
OVERSIZE = 512 << 20
#: Contents are handed on once so many bytes are read.
BATCH_BYTES = 8 << 20
STAT = "path string, abs string, host string, mode int, uid int, gid int, size long, mtime string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


def stamp(ns: int) -> str:
    """Seconds and nine digits of nanoseconds."""
    return f"{ns // 1_000_000_000}.{ns % 1_000_000_000:09d}"


def walk(root: str, skipped: tuple[str, ...], ignore: bool = False, deep: bool = True) -> Iterator[tuple[str, os.stat_result]]:
    """Regular files below a folder; links aren't followed, folders of the skipped names aren't entered."""
    stack = [(root, [])]
    while stack:
        folder, rules = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        if ignore:
            rules = [*rules, *_rules(folder)]
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                if deep and entry.name not in skipped and not _ignored(entry, True, rules):
                    stack.append((entry.path, rules))
            elif entry.is_file(follow_symlinks=False) and not _ignored(entry, False, rules):
                try:
                    yield entry.path, entry.stat(follow_symlinks=False)
                except OSError:
                    continue


class Ignore(NamedTuple):
    """A line of an ignore file: the folder it lies in, what paths below it have to match, whether it takes them back, and whether it is for folders only."""

    base: str
    match: re.Pattern
    negated: bool
    folders: bool


def glob(pattern: str) -> re.Pattern:
    """An ignore pattern as a regex over paths from the folder of its file.

    A slash at the start or inside ties it to that folder, else it holds at any depth; ``*`` and ``?`` stay within a name, ``**``
    stands for any folders; ``[...]`` is one sign of a set, and a backslash takes the next sign as it is.
    """
    tied = "/" in pattern
    rest, out = pattern.lstrip("/"), "" if tied else "(?:.*/)?"
    at = 0
    while at < len(rest):
        if rest.startswith("**/", at) and (at == 0 or rest[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif rest.startswith("**", at) and at + 2 == len(rest) and (at == 0 or rest[at - 1] == "/"):
            out, at = out + ".+", at + 2
        elif rest[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif rest[at] == "?":
            out, at = out + "[^/]", at + 1
        elif rest[at] == "[" and (end := rest.find("]", at + 2)) > 0:
            body = rest[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, at = out + f"[{'^' + body[1:] if body[0] in '!^' else body}]", end + 1
        else:
            at += rest[at] == "\\" and at + 1 < len(rest)
            out, at = out + re.escape(rest[at]), at + 1
    return re.compile(out, re.S)


def _rules(folder: str) -> list[Ignore]:
    """The lines of the folder's ignore files."""
    out = []
    for name in (".gitignore", ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                lines = f.read().splitlines()
        except OSError:
            continue
        for line in map(str.rstrip, lines):
            if line and not line.startswith("#"):
                negated, line = line.startswith("!"), line.removeprefix("!")
                try:
                    out.append(Ignore(folder, glob(line.rstrip("/")), negated, line.endswith("/")))
                except re.error:  # a set that isn't one matches nothing
                    continue
    return out


def _ignored(entry: os.DirEntry, folder: bool, rules: list[Ignore]) -> bool:
    """What the last line that matches says."""
    for rule in reversed(rules):
        if (folder or not rule.folders) and rule.match.fullmatch(os.path.relpath(entry.path, rule.base)):
            return not rule.negated
    return False


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skipped: tuple[str, ...], ignore: bool) -> None:
        self.root, self.skipped, self.ignore = root, skipped, ignore

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and each folder below it; one partition where ignore files count, as they reach downwards."""
        if self.ignore:
            return [_Folder(self.root, True)]
        below = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in self.skipped]
        return [_Folder(self.root, False), *[_Folder(p, True) for p in sorted(below)]]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for path, s in walk(partition.path, self.skipped, self.ignore, partition.deep):
            yield path, os.path.realpath(path), "", modes.S_IMODE(s.st_mode), s.st_uid, s.st_gid, s.st_size, stamp(s.st_mtime_ns)


class TreeSource(DataSource):
    """format("tree"): options path, skip (comma-joined names) and ignore (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return STAT

    def reader(self, schema) -> DataSourceReader:
        names = self.options.get("skip")
        skipped = tuple(names.split(",")) if names is not None else SKIP_DIRS
        return TreeReader(self.options["path"], (*skipped, *ALWAYS_SKIPPED), self.options.get("ignore", "false").lower() == "true")


def listing(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIP_DIRS, ignore: bool = False) -> DataFrame:
    """What stat says of each file under a root that the executors can read."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("path", root).option("skip", ",".join(skip)).option("ignore", str(ignore)).load()


def contents(files: DataFrame) -> DataFrame:
    """The rows with hash, content (null for large or unreadable files) and status: scanned, oversize or unreadable."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_dict("records"):
                digest, data, status = None, None, "scanned"
                try:
                    with open(row["path"], "rb") as f:
                        if row["size"] > OVERSIZE:
                            status, h = "oversize", hashlib.sha256()
                            while block := f.read(1 << 20):
                                h.update(block)
                            digest = h.hexdigest()
                        else:
                            data = f.read()
                            digest = hashlib.sha256(data).hexdigest()
                except OSError:
                    status = "unreadable"
                rows.append({**row, "hash": digest, "content": data, "status": status})
                held += len(data or b"")
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield pd.DataFrame(rows)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows)

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(read, f"{columns}, hash string, content binary, status string")


def text(content: str = "content"):
    """Content as text, bad bytes replaced."""
    return F.make_valid_utf8(F.col(content).cast("string"))
