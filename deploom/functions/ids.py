"""Column functions over dotted ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(c: Column) -> Column:
    return F.split(c, r"\.")


def depth(c: Column) -> Column:
    """Number of segments, counted by dots."""
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1


def prefix(c: Column, n: Column) -> Column:
    """The first n segments, cut from the text as it is."""
    return F.call_function("substring_index", c, F.lit("."), n)


def top(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def last(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def parent(c: Column) -> Column:
    """The id without its last segment; null for a root."""
    return F.when(F.contains(c, F.lit(".")), F.substring(c, F.lit(1), F.length(c) - F.length(last(c)) - 1))


def ancestors(c: Column, with_self: bool = False) -> Column:
    """Dotted prefixes from the root down."""
    n = depth(c) - (0 if with_self else 1)
    build = F.transform(F.sequence(F.lit(1), n), lambda i: prefix(c, i))
    return F.when(n >= 1, build).otherwise(F.array().cast("array<string>"))


#: Different depths of ids that are looked up one by one.
DEPTHS = 8


def depths(ids: DataFrame, column: str = "id") -> list[int] | None:
    """The different depths of ids, or None if they are more than DEPTHS."""
    found = [r[0] for r in ids.where(F.col(column).isNotNull()).select(depth(F.col(column))).distinct().limit(DEPTHS + 1).collect()]
    return sorted(found) if len(found) <= DEPTHS else None


def ancestors_at(c: Column, levels: list[int]) -> Column:
    """The ancestors of given depths, null for those that an id doesn't have."""
    return F.array(*[F.when(depth(c) > d, prefix(c, F.lit(d))) for d in levels]).cast("array<string>")


def is_ancestor(a: Column, d: Column) -> Column:
    """Whether a is a strict dotted prefix of d."""
    return F.startswith(d, F.concat(a, F.lit(".")))


def common_depth(a: Column, b: Column) -> Column:
    """Number of leading segments that two ids share."""
    same = F.zip_with(segments(a), segments(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(same))


def lift(c: Column, n: Column) -> Column:
    """The first n segments."""
    return prefix(c, F.greatest(n, F.lit(1)).cast("int"))


def fnv1a_all(texts: list[bytes]) -> list[int]:
    """64-bit FNV-1a of each text; the texts take their bytes in step, and a few long ones go on alone."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    start = (np.cumsum(size) - size).astype(np.int64)
    joined = b"".join(texts[k] for k in order)
    data, h = np.frombuffer(joined, np.uint8), np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    at, left = 0, int(np.searchsorted(-size, 0))
    while left >= 16:
        h[:left] = (h[:left] ^ data[start[:left] + at]) * np.uint64(0x100000001B3)
        at += 1
        left = int(np.searchsorted(-size, -at))
    out = [0] * len(texts)
    for k, (own, value) in enumerate(zip(order.tolist(), h.tolist(), strict=True)):
        for b in joined[start[k] + at : start[k] + size[k]]:
            value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        out[own] = value
    return out


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hex digits; null for null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[known] = [f"{h:016x}" for h in fnv1a_all([t.encode() for t in s[known]])]
        return out

    return run(c)
