"""Look-alike names, hosts and addresses, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter protected names have no look-alikes; fixed value.
LEAST_PROTECTED = 4


def fold(name: Column) -> Column:
    """Look-alike signs to letters."""
    return F.translate(F.regexp_replace(F.regexp_replace(name, "rn", "m"), "vv", "w"), "0134579", "oleastg")


def one_edit(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of exactly 1: an edit, or a swap of neighbours."""
    n = F.length(a)
    swap = (n == F.length(b)) & (a != b) & F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b,
    )
    return (F.levenshtein(a, b) == 1) | swap


def impersonates(name: Column, protected: Column) -> Column:
    """A look-alike of a protected name, not the name itself."""
    return (F.length(protected) >= LEAST_PROTECTED) & (name != protected) & ((fold(name) == protected) | one_edit(name, protected))


def host_of(url: Column) -> Column:
    """Host of a URL: no scheme, path, user or port, lower case; null if there is none."""
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.when(host != "", host)


def parents(domain: Column) -> Column:
    """The domain and its parents with two labels at least, nearest first."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ipv4(text: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = F.split(text, r"\.")
    ok = text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(parts, lambda p: p.cast("int") <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long")))


#: Address blocks that public names shouldn't resolve to: first address and prefix length; fixed values.
RESERVED = (("0.0.0.0", 32), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("255.255.255.255", 32))


def reserved(text: Column) -> Column:
    """Whether an IPv4 address lies in a reserved block."""
    value = ipv4(text)
    out = F.lit(False)
    for block, bits in RESERVED:
        base = sum(int(p) << s for p, s in zip(block.split("."), (24, 16, 8, 0), strict=True))
        out = out | value.between(base, base + (1 << (32 - bits)) - 1)
    return F.coalesce(out, F.lit(False))
