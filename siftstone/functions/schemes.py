"""Which patterns are indicators of compromise rather than regexes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of each digest; fixed values.
DIGESTS = {"md5": 32, "sha1": 40, "sha256": 64}
NETWORK = ("domain", "ip", "url")


def scheme(pattern: str) -> str | None:
    """``md5``, ``sha1``, ``sha256``, ``domain``, ``ip``, ``url``, ``breach-email``, ``yara``, or None for a regex."""
    head, _, rest = pattern.partition(":")
    kind = head.lower()
    if kind in DIGESTS:
        return kind if re.fullmatch(f"[0-9a-fA-F]{{{DIGESTS[kind]}}}", rest.strip()) else None
    if head in (*NETWORK, "breach-email", "yara") and rest:
        return head
    return None


_SCHEME = "^(" + "|".join(f"(?i:{kind})(?=: *[0-9a-fA-F]{{{size}}} *$)" for kind, size in DIGESTS.items()) + f"|(?:{'|'.join(NETWORK)}|breach-email|yara)(?=: *[^ ]))"


def scheme_of(pattern: Column) -> Column:
    """The same as an expression: one regex, as a case per scheme grows beyond what can be compiled."""
    kind = F.lower(F.regexp_extract(pattern, _SCHEME, 1))
    return F.nullif(kind, F.lit(""))


def value_of(pattern: Column) -> Column:
    """What follows the scheme: lower case but for URLs."""
    rest = F.trim(F.expr("substring(pattern, instr(pattern, ':') + 1)"))
    return F.when(pattern.startswith("url:"), rest).otherwise(F.lower(rest))
