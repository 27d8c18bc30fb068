"""Shell patterns as regular expressions of the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = set(".^$*+?{}[]\\|()&~#-<>!=:/\"'@%`, ")


def to_regex(pattern: str) -> str:
    """`*`, `?`, `[seq]` and `[!seq]` as fnmatch has them; matches whole strings and any character, line ends too."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))) > 0:
            body = pattern[i:end]
            i = end + 1
            negated, body = body[:1] == "!", body[body[:1] == "!" :]
            inner = "".join(x if x == "-" or x.isalnum() or ord(x) > 127 else "\\" + x for x in body)
            out.append(f"[{'^' if negated else ''}{inner}]")
        else:
            out.append("\\" + c if c in SPECIAL else c)
    return "(?s)\\A" + "".join(out) + "\\z"


def matches(c: Column, pattern: str) -> Column:
    """Whether a value matches; plain prefixes become startswith, which Parquet scans can use."""
    if not re.search(r"[*?\[]", pattern):
        return c == F.lit(pattern)
    if re.fullmatch(r"[^*?\[]+\*", pattern):
        return F.startswith(c, F.lit(pattern[:-1]))
    return F.rlike(c, F.lit(to_regex(pattern)))
