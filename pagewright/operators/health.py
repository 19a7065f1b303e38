"""Health-check data work: accepted statuses and log scanning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a log line as an error; lines naming a retry are skipped.
ERROR_WORDS = "error|exception|fatal|failed|crash"
RETRY_WORD = "retry"
DEFAULT_ACCEPTED = ((200, 300),)


def status_acceptable(status, ranges=DEFAULT_ACCEPTED) -> Column:
    """Status inside any accepted half-open range; NULL status is not accepted."""
    s = F.col(status) if isinstance(status, str) else status
    hit = None
    for lo, hi in ranges:
        h = (s >= lo) & (s < hi)
        hit = h if hit is None else (hit | h)
    return F.coalesce(hit, F.lit(False))


def error_log_lines(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """Lines with an error word (any case) that do not mention 'retry' (exact case)."""
    t = F.col(text_col)
    return lines.filter(t.rlike("(?i)" + ERROR_WORDS) & ~F.contains(t, F.lit(RETRY_WORD)))


def error_sample(lines: DataFrame, n: int = 5, order: str = "log_time") -> DataFrame:
    """The first ``n`` error lines (the health check's sample)."""
    return error_log_lines(lines).orderBy(order, "line").limit(n)


def tail(lines: DataFrame, n: int = 50, order: str = "log_time") -> DataFrame:
    """The last ``n`` lines by time (``tail -n``)."""
    return lines.orderBy(F.desc(order), F.desc("line")).limit(n)
