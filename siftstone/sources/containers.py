"""Containers to their members: zip, tar, gzip, SQLite and ISO images, also inside one another. Caps count what is emitted."""

from __future__ import annotations

import hashlib
import io
import lzma
import sqlite3
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Caps; fixed values: bytes of a container, members, bytes of a member, bytes in all, levels.
INPUT, MEMBERS, MEMBER_BYTES, TOTAL_BYTES, DEPTH = 2 << 30, 10_000, 32 << 20, 256 << 20, 8
#: SQLite: rows and bytes of a table, bytes in all, tables; ISO: bytes of a file, levels; fixed values.
ROWS, TABLE_BYTES, DATABASE_BYTES, TABLES = 10_000, 8 << 20, 64 << 20, 500
ISO_BYTES, ISO_DEPTH = 8 << 20, 16


class Emitter:
    """Members within the caps. ``whole``: too large members are left out; else they are cut."""

    def __init__(self, container: str) -> None:
        self.container, self.left, self.count = container, TOTAL_BYTES, 0

    @property
    def full(self) -> bool:
        return self.count >= MEMBERS or self.left <= 0

    def member(self, name: str, content: bytes, whole: bool = True) -> tuple[str, bytes] | None:
        if self.full:
            return None
        if len(content) > min(MEMBER_BYTES, self.left):
            if whole:
                return None
            content = content[: min(MEMBER_BYTES, self.left)]
        self.count += 1
        self.left -= len(content)
        return f"{self.container}!{name}", content


def leaf(path: str) -> str:
    return path.replace("\\", "/").replace("!", "/").rsplit("/", 1)[-1]


def kind(path: str, content: bytes) -> str | None:
    """zip, tar, tar.gz, gz, sqlite or iso by name (and mark where one is needed); None for other files."""
    name = leaf(path).lower()
    if name.endswith((".zip", ".jar", ".war")):
        return "zip"
    if name.endswith(".tar"):
        return "tar"
    if name.endswith((".tar.gz", ".tgz")):
        return "tar.gz"
    if name.endswith(".gz"):
        return "gz"
    if name.endswith((".db", ".sqlite", ".sqlite3")) and content[:16] == b"SQLite format 3\x00":
        return "sqlite"
    if name.endswith((".iso", ".img", ".udf")) and content[32769:32774] == b"CD001":
        return "iso"
    return None


def _inflate(content: bytes, most: int) -> bytes:
    """What can be read of gzip data, up to a size; broken ends are kept as far as they go."""
    out, engine = bytearray(), zlib.decompressobj(31)
    try:
        while content and len(out) < most:
            out += engine.decompress(content, most - len(out))
            content = engine.unconsumed_tail
            if engine.eof and engine.unused_data:
                content, engine = engine.unused_data, zlib.decompressobj(31)
            elif engine.eof:
                break
    except zlib.error:
        pass
    return bytes(out)


def _zip(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    emit = Emitter(path)
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for entry in archive.infolist():
            if emit.full:
                return
            if entry.is_dir() or entry.file_size > MEMBER_BYTES:
                continue
            try:
                with archive.open(entry) as f:
                    data = f.read(MEMBER_BYTES + 1)
            except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, EOFError, OSError, lzma.LZMAError):
                continue
            if found := emit.member(entry.filename, data):
                yield found


def _tar(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    emit = Emitter(path)
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as archive:
        for entry in archive:
            if emit.full:
                return
            if not entry.isfile():
                continue
            data = archive.extractfile(entry)
            if data is not None and (found := emit.member(entry.name, data.read(MEMBER_BYTES), whole=False)):
                yield found


def _sqlite(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    emit, total = Emitter(path), 0
    base = sqlite3.connect(":memory:")
    try:
        base.deserialize(content)
        base.text_factory = lambda b: b.decode("utf-8", "replace")
        tables = [r[0] for r in base.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for table in tables[:TABLES]:
            out = bytearray()
            quoted = table.replace('"', '""')
            cursor = base.execute(f'SELECT * FROM "{quoted}" LIMIT {ROWS}')
            columns = [c[0] for c in cursor.description]
            for row in cursor:
                cells = [f"{c}=<blob {len(v)} bytes>" if isinstance(v, bytes) else f"{c}={v}" for c, v in zip(columns, row, strict=True) if v is not None]
                out += (" ".join(cells) + "\n").encode()
                if len(out) > TABLE_BYTES or total + len(out) > DATABASE_BYTES:
                    break
            out = out[: min(TABLE_BYTES, DATABASE_BYTES - total)]
            total += len(out)
            if out and (found := emit.member(table, bytes(out), whole=False)):
                yield found
    finally:
        base.close()


def _iso(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of an ISO 9660 image; Joliet names where there are any."""
    emit, root, wide = Emitter(path), None, False
    for sector in range(16, 64):
        block = content[sector * 2048 : sector * 2048 + 2048]
        if len(block) < 2048 or block[1:6] != b"CD001" or block[0] == 255:
            break
        joliet = block[0] == 2 and block[88:91] in (b"%/@", b"%/C", b"%/E")
        if block[0] == 1 and root is None or joliet and not wide:
            root, wide = block[156:190], joliet
    if root is None:
        return
    seen: set[int] = set()
    stack = [(struct.unpack_from("<I", root, 2)[0], struct.unpack_from("<I", root, 10)[0], "", 0)]
    while stack and not emit.full:
        at, size, prefix, depth = stack.pop()
        if at in seen or depth > ISO_DEPTH:
            continue
        seen.add(at)
        data, i = content[at * 2048 : at * 2048 + size], 0
        below = []
        while i < len(data):
            n = data[i]
            if n == 0:
                i = (i // 2048 + 1) * 2048
                continue
            entry = data[i : i + n]
            i += n
            if len(entry) < 34:
                break
            raw = entry[33 : 33 + entry[32]]
            if raw in (b"\x00", b"\x01"):
                continue
            name = raw.decode("utf-16-be" if wide else "latin-1", "replace").split(";")[0].rstrip(".")
            place, length = struct.unpack_from("<I", entry, 2)[0], struct.unpack_from("<I", entry, 10)[0]
            if entry[25] & 2:
                below.append((place, length, f"{prefix}{name}/", depth + 1))
            elif found := emit.member(f"{prefix}{name}", content[place * 2048 : place * 2048 + min(length, ISO_BYTES)], whole=False):
                yield found
        stack.extend(reversed(below))


def members(path: str, content: bytes) -> list[tuple[str, bytes]]:
    """The members of one container; nothing for other files and unreadable containers."""
    if len(content) > INPUT:
        return []
    what, out = kind(path, content), []
    try:
        if what == "zip":
            out.extend(_zip(path, content))
        elif what == "tar":
            out.extend(_tar(path, content))
        elif what == "tar.gz":
            out.extend(_tar(path, _inflate(content, TOTAL_BYTES)))
        elif what == "gz":
            data = _inflate(content, MEMBER_BYTES)
            name = leaf(path)[:-3]
            if data and (found := Emitter(path).member(name, data, whole=False)):
                out.append(found)
        elif what == "sqlite":
            out.extend(_sqlite(path, content))
        elif what == "iso":
            out.extend(_iso(path, content))
    except (zipfile.BadZipFile, tarfile.TarError, sqlite3.Error, EOFError, ValueError, struct.error, OSError):
        pass
    return out


def unpack(path: str, content: bytes, depth: int = DEPTH) -> Iterator[tuple[str, bytes, str, int]]:
    """(path, content, hash of the container, level) of every member, also of members, depth first."""
    stack = [(path, content, 1)]
    while stack:
        at, data, level = stack.pop()
        if level > depth:
            continue
        found = members(at, data)
        if not found:
            continue
        digest = hashlib.sha256(data).hexdigest()
        for name, inner in found:
            yield name, inner, digest, level
        stack.extend((n, d, level + 1) for n, d in reversed(found))


def expand(files: DataFrame) -> DataFrame:
    """(path, content, container_hash, depth): the files themselves (depth 0, no container) and all their members."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if content is None:
                    continue
                block, size = [], 0
                for row in unpack(path, bytes(content)):
                    block.append(row)
                    size += len(row[1])
                    if size > 32 << 20:
                        yield pd.DataFrame(block, columns=["path", "content", "container_hash", "depth"])
                        block, size = [], 0
                if block:
                    yield pd.DataFrame(block, columns=["path", "content", "container_hash", "depth"])

    own = files.select("path", "content", F.lit(None).cast("string").alias("container_hash"), F.lit(0).alias("depth"))
    archives = files.select("path", "content").where(F.lower("path").rlike(r"\.(zip|jar|war|tar|tgz|gz|db|sqlite|sqlite3|iso|img|udf)$"))
    return own.unionByName(archives.mapInPandas(scan, "path string, content binary, container_hash string, depth int"))


