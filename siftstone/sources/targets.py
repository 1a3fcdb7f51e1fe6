"""What a scan is pointed at: paths, pages, sockets, processes and sweeps."""

from __future__ import annotations

import ipaddress
import os
import re
import socket
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Host and port pairs of a sweep at most; fixed value.
MOST = 65_536
#: Ports that a sweep asks first; fixed values.
_FIRST = (
    80, 443, 8080, 8443, 8000, 8888, 8008, 8081, 8181, 8090, 3000, 5000, 9000, 4200, 4443, 7001, 7080, 9090, 9443, 10000, 8085, 8086, 8161, 2375, 2376,
    22, 23, 3389, 5900, 5901, 5985, 5986, 512, 513, 514, 623, 992, 2222,
    21, 20, 445, 139, 137, 138, 2049, 111, 873, 989, 990, 115, 69, 548, 427,
    25, 110, 143, 465, 587, 993, 995, 24, 209, 1109,
    3306, 5432, 1433, 1521, 1830, 27017, 27018, 27019, 6379, 11211, 9042, 7000, 7199, 5984, 8529, 9200, 9300, 2483, 2484, 50000, 3050, 5433, 26257,
    389, 636, 88, 464, 749, 3268, 3269, 1812, 1813, 1645, 1646, 49, 750,
    53, 5353, 5355, 1900, 3702, 17500, 5060, 5061, 4569,
    161, 162, 199, 2379, 2380, 6443, 10250, 10255, 4001, 7946, 8300, 8301, 8500, 8600, 2181, 9092, 5672, 15672, 4369, 25672, 61616, 1883, 8883,
    9418, 3690, 8929, 5050, 8153, 4873, 5001,
    515, 631, 9100, 79, 113, 119, 563, 543, 544, 1080, 3128, 8118,
    135, 593, 1099, 1098, 4444, 8009, 8880, 9001, 9002, 9080, 7777, 16992, 16993, 5555, 5560, 1494, 2598,
    502, 20000, 44818, 47808, 1911, 4840, 102, 2404, 789,
)
#: Ports of a sweep in all, unless it is given a ranking of its own; after the first ones come the rest of the system's ports in ascending order.
RANKED = 750
PORTS = (*_FIRST, *[p for p in range(1, 1024) if p not in _FIRST][: RANKED - len(_FIRST)])


class Target(NamedTuple):
    kind: str  # path, web, tcp, processes, ports
    values: tuple[str, ...]


def parse(args: list[str]) -> Target:
    """None: the current folder. ``ports``: a sweep of what follows. Pages by scheme, sockets if all are host:port; else a path."""
    if not args:
        return Target("path", (".",))
    if args[0] == "ports":
        return Target("ports", tuple(args[1:]))
    if args[0] == "processes":
        return Target("processes", ())
    if re.match(r"https?://", args[0]):
        return Target("web", tuple(args))
    parts = [p for a in args for p in a.split(",") if p]
    if parts and all(re.fullmatch(r"[\w.-]+:\d{1,5}", p) and 0 < int(p.rsplit(":", 1)[1]) < 65536 for p in parts) and not os.path.exists(args[0]):
        return Target("tcp", tuple(parts))
    return Target("path", (args[0],))


def ports(text: str, top: int = 100, ranking: Sequence[int] = PORTS) -> list[int]:
    """``22,80``, ``1-3`` and ``common`` (the first ``top`` of a ranking), in order, once each."""
    out: list[int] = []
    for part in filter(None, map(str.strip, text.split(","))):
        if part == "common":
            out += ranking[:top]
        elif found := re.fullmatch(r"(\d+)-(\d+)", part):
            out += range(int(found[1]), int(found[2]) + 1)
        else:
            out.append(int(part))
    if any(not 0 < p < 65536 for p in out):
        raise ValueError(f"no port: {text!r}")
    return list(dict.fromkeys(out))


def sweep(spark: SparkSession, hosts: str, asked: str = "common", top: int = 100, ranking: Sequence[int] = PORTS) -> DataFrame:
    """(host, port) of every host (names, addresses, IPv4 blocks) and port; ValueError beyond MOST pairs."""
    listed = ports(asked, top, ranking)
    named: list[tuple[str, int, int]] = []
    count = 0
    for part in filter(None, map(str.strip, hosts.split(","))):
        if "/" in part:
            block = ipaddress.ip_network(part, strict=False)
            first, n = int(block.network_address), block.num_addresses
            if n > 2:
                first, n = first + 1, n - 2
            named.append(("", first, n))
        else:
            named.append((part, 0, 1))
        count += named[-1][2]
    if count * len(listed) > MOST:
        raise ValueError(f"{count * len(listed)} targets are more than {MOST}")
    rows = spark.createDataFrame(named, "name string, first long, n long").select("name", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("a"))
    octet = lambda s: F.shiftright("a", s).bitwiseAND(F.lit(255))
    host = F.when(F.col("name") != "", F.col("name")).otherwise(F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))
    return rows.select(host.alias("host"), F.explode(F.array(*map(F.lit, listed))).alias("port"))


def service(banner: Column) -> Column:
    """(service, version) that a banner tells: ssh, http (a Server line), ftp or smtp (a 220 greeting); empty strings for others."""
    lines = F.split(banner, r"\r?\n")
    greeting = F.coalesce(F.trim(F.get(F.filter(lines, lambda x: (F.trim(x) != "") & ~x.startswith("target=")), 0)), F.lit(""))
    server = F.get(F.filter(lines, lambda x: x.rlike("^[Ss]erver:")), 0)
    pair = lambda name, version: F.struct(F.lit(name).alias("service"), version.alias("version"))
    rest = F.trim(F.regexp_replace(greeting, "^(?:220)+", ""))
    version = F.coalesce(F.get(F.split(F.regexp_replace(greeting, "^SSH-", ""), "[- ]"), 1), F.lit(""))
    return (
        F.when(greeting.startswith("SSH-"), pair("ssh", version))
        .when(server.isNotNull(), pair("http", F.trim(F.regexp_replace(server, "^[Ss]erver:", ""))))
        .when(greeting.startswith("220") & F.lower(greeting).contains("ftp"), pair("ftp", rest))
        .when(greeting.startswith("220"), pair("smtp", rest))
        .otherwise(pair("", F.lit("")))
    )


class _One(InputPartition):
    def __init__(self, value: str) -> None:
        self.value = value


class _Processes(DataSourceReader):
    def read(self, partition) -> Iterator[tuple]:
        for name in sorted(filter(str.isdigit, os.listdir("/proc")), key=int) if os.path.isdir("/proc") else []:
            try:
                with open(f"/proc/{name}/comm") as f:
                    comm = f.read().strip()
                with open(f"/proc/{name}/cmdline", "rb") as f:
                    line = f.read().replace(b"\0", b" ").decode("utf-8", "replace").strip()
            except OSError:
                continue
            try:
                exe = os.readlink(f"/proc/{name}/exe")
            except OSError:
                exe = ""
            yield f"proc://{name}", f"pid={name}\nname={comm}\nexe={exe}\ncmdline={line}\n"


class ProcessSource(DataSource):
    """format("processes"): the processes of the machine that reads."""

    @classmethod
    def name(cls) -> str:
        return "processes"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Processes()


class _Banners(DataSourceReader):
    def __init__(self, targets: list[str]) -> None:
        self.targets = targets

    def partitions(self) -> list[InputPartition]:
        return [_One(t) for t in self.targets]

    def read(self, partition: _One) -> Iterator[tuple]:
        host, _, port = partition.value.rpartition(":")
        try:
            with socket.create_connection((host, int(port)), 3) as link:
                link.settimeout(2)
                try:
                    data = link.recv(8192)
                except TimeoutError:
                    link.sendall(b"HEAD / HTTP/1.0\r\n\r\n")
                    data = link.recv(8192)
        except OSError:
            return
        yield f"tcp://{partition.value}", f"target={partition.value}\n" + data.decode("utf-8", "replace")


class BannerSource(DataSource):
    """format("banners"): what sockets say; needs option active=true, as it connects to them."""

    @classmethod
    def name(cls) -> str:
        return "banners"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("active", "false").lower() != "true":
            raise ValueError("connecting to targets needs active=true")
        return _Banners([t for t in self.options["targets"].split(",") if t])
