"""Tokens, hashes and parents of paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(path: Column) -> Column:
    """Parts of a path (also of containers): directories in lower case, the last as <ext:x> or <noext>."""
    parts = F.filter(F.split(path, r"[/\\!]"), lambda p: (p != "") & (p != "."))
    last = F.element_at(parts, -1)
    suffix = F.regexp_extract(last, r"^.+\.([^.]+)$", 1)
    leaf = F.when(suffix != "", F.concat(F.lit("<ext:"), F.lower(suffix), F.lit(">"))).otherwise("<noext>")
    heads = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    return F.when(F.size(parts) > 0, F.concat(heads, F.array(leaf))).otherwise(F.array().cast("array<string>"))


def fnv1a(values: pd.Series) -> np.ndarray:
    """64-bit FNV-1a of strings (offset and prime are fixed values)."""
    out = np.empty(len(values), np.uint64)
    for i, text in enumerate(values):
        h = 1469598103934665603
        for b in text.encode():
            h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


def held_out(share: float, shift: int = 11):
    """A UDF: whether a path is in the share that is held out (the same for each run)."""

    def pick(paths: pd.Series) -> pd.Series:
        return pd.Series((fnv1a(paths) >> np.uint64(shift)) % np.uint64(10_000) / 10_000.0 < share)

    return F.pandas_udf(pick, "boolean")
