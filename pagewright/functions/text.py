"""Text expressions: whitespace, blank lines, publish-time extraction.

Regex notes (Java vs Python): Python's ``\\s``/``\\d`` are Unicode and its
``$`` (without MULTILINE) also matches before a final ``\\n``.  Java gets the
same behaviour with ``(?U)`` (Unicode classes), ``(?d)`` (only ``\\n`` ends a
line) and ``(?s)`` for DOTALL.  Every pattern below is written in Python
syntax and given the ``(?Uds)`` prefix when turned into a Spark pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

JAVA_FLAGS = "(?Uds)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java(pattern: str) -> str:
    """Python-syntax pattern -> Java pattern with the same meaning.

    Only the flags that can change the result are set (each costs time on
    long texts): U when the pattern uses a shorthand class, s when it has '.',
    d when it has an anchor.
    """
    flags = ""
    if re.search(r"\\[sSdDwWbB]", pattern):
        flags += "U"
    if "." in pattern.replace("\\.", ""):
        flags += "s"
    if "$" in pattern or "^" in pattern.replace("[^", ""):
        flags += "d"
    return (f"(?{flags})" if flags else "") + pattern


def strip(s) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(s), r"(?U)\A\s+|\s+\z", "")


def collapse_blank_lines(s) -> Column:
    """A newline, any whitespace, a newline -> exactly two newlines."""
    return F.regexp_replace(_c(s), java(r"\n\s*\n"), "\n\n")


def collapse_and_strip(s) -> Column:
    return strip(collapse_blank_lines(s))


def cut(s, pattern: str) -> Column:
    """Remove every match of ``pattern`` (Python syntax)."""
    return F.regexp_replace(_c(s), java(pattern), "")


# Publish-time patterns, tried in this order (first hit wins).
PUBLISH_TIME_PATTERNS = [
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?)",
    r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}(?::\d{2})?)",
    r"(\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}(?::\d{2})?)",
]


def first_match(s, pattern: str) -> Column:
    """First match group 1 of a Python-syntax pattern, NULL when absent."""
    return F.nullif(F.regexp_extract(_c(s), java(pattern), 1), F.lit(""))


# any of the three date shapes (a pre-check: texts without one skip the ordered scans)
ANY_DATE = r"\d{4}[-/.]\d{2}[-/.]\d{2} \d{2}:\d{2}"


def publish_time_extract(content) -> Column:
    """'YYYY-MM-DD HH:MM:SS' from the first pattern that matches, else NULL.

    Patterns are tried in order (not by position).  One combined scan first
    checks that some date shape occurs at all, so most texts without a date
    cost one pass instead of three.
    """
    ordered = F.coalesce(*[first_match(content, p) for p in PUBLISH_TIME_PATTERNS])
    hit = F.when(F.regexp_like(_c(content), F.lit(java(ANY_DATE))), ordered)
    norm = F.translate(hit, "/.", "--")
    return F.when(F.length(norm) == 16, F.concat(norm, F.lit(":00"))).otherwise(norm)


def publish_time_nullify(value) -> Column:
    """Empty publish time -> NULL; otherwise parsed to TIMESTAMP_NTZ."""
    v = F.nullif(strip(_c(value)), F.lit(""))
    return F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm[:ss]")).cast("timestamp_ntz")


def content_hash(s) -> Column:
    """md5 hex of the UTF-8 text."""
    return F.md5(_c(s))


MAX_CONTENT_CHARS = 65535


def truncate_content(content, limit: int = MAX_CONTENT_CHARS) -> Column:
    return F.left(_c(content), F.lit(limit))


def reason_preview(reason, width: int = 100) -> Column:
    r = _c(reason)
    return F.when(F.length(r) < width, r).otherwise(F.concat(F.left(r, F.lit(width)), F.lit("...")))


_META = set("\\[](){}.*+?^$|")


def literal_prefix(pattern: str) -> str:
    """Leading literal text every match of a Python-syntax pattern starts with."""
    out = []
    for ch in pattern:
        if ch in _META:
            if ch in "*?{" and out:  # the quantifier makes the last character optional
                out.pop()
            break
        out.append(ch)
    return "".join(out)
