"""Error classification and retry arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The seven error categories.
NETWORK, SERVER, CLIENT, RATE_LIMIT = "network_error", "server_error", "client_error", "rate_limit"
PARSING, PERMISSION, UNKNOWN = "parsing_error", "permission_error", "unknown_error"
CATEGORIES = [NETWORK, SERVER, CLIENT, RATE_LIMIT, PARSING, PERMISSION, UNKNOWN]

# Words in an exception name, network words checked first.
NETWORK_WORDS = ["timeout", "connection", "socket", "ssl", "dns", "network"]
PARSING_WORDS = ["parse", "json", "decode", "syntax", "value", "attribute", "key", "index"]

# Retry policy per category (max retries, base delay range in s).
POLICY = [
    (NETWORK, 5, 5.0, 15.0),
    (SERVER, 3, 10.0, 30.0),
    (CLIENT, 1, 5.0, 10.0),
    (RATE_LIMIT, 8, 30.0, 60.0),
    (PARSING, 2, 5.0, 15.0),
    (PERMISSION, 1, 60.0, 120.0),
    (UNKNOWN, 3, 10.0, 20.0),
]
# Fallbacks for a category the policy does not list, backoff, cap.
FALLBACK_MAX_RETRIES, FALLBACK_MIN_DELAY, FALLBACK_MAX_DELAY = 3, 10.0, 30.0
BACKOFF_FACTOR, JITTER, MAX_RETRY_DELAY = 2.0, 0.1, 3600.0

# Fetch-level retry loop (attempts, base delay range in s).
FETCH_MAX_RETRIES, FETCH_MIN_DELAY, FETCH_MAX_DELAY = 3, 3.0, 10.0

POLICY_SCHEMA = T.StructType([
    T.StructField("error_category", T.StringType(), False),
    T.StructField("max_retries", T.IntegerType(), False),
    T.StructField("min_delay", T.DoubleType(), False),
    T.StructField("max_delay", T.DoubleType(), False),
])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_status(status) -> Column:
    """429 rate_limit, 403 permission, other 4xx client, 5xx server, else NULL."""
    s = _c(status)
    return (F.when(s == 429, F.lit(RATE_LIMIT)).when(s == 403, F.lit(PERMISSION))
            .when((s >= 400) & (s < 500), F.lit(CLIENT)).when((s >= 500) & (s < 600), F.lit(SERVER)))


def _any_word(name: Column, words) -> Column:
    out = None
    for w in words:
        hit = F.contains(name, F.lit(w))
        out = hit if out is None else (out | hit)
    return out


def classify_error(error_name, status) -> Column:
    """Category of a raised error: status first, then words in the exception name."""
    name = F.lower(F.coalesce(_c(error_name), F.lit("")))
    return F.coalesce(
        classify_status(status),
        F.when(_any_word(name, NETWORK_WORDS), F.lit(NETWORK))
        .when(_any_word(name, PARSING_WORDS), F.lit(PARSING))
        .otherwise(F.lit(UNKNOWN)))


def classify_error_text(status) -> Column:
    """Category of a text error: status only."""
    return F.coalesce(classify_status(status), F.lit(UNKNOWN))


def policy_table(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """The seven-row policy table, with optional user overrides applied.

    ``overrides`` has ``error_category`` and any of ``max_retries``,
    ``min_delay``, ``max_delay`` (NULL keeps the built-in value).
    """
    base = spark.createDataFrame(POLICY, POLICY_SCHEMA)
    if overrides is None:
        return base
    o = overrides.select(
        "error_category",
        *[F.col(c).cast(t).alias("o_" + c) if c in overrides.columns else F.lit(None).cast(t).alias("o_" + c)
          for c, t in (("max_retries", "int"), ("min_delay", "double"), ("max_delay", "double"))])
    j = base.join(o, "error_category", "full")
    return j.select(
        "error_category",
        F.coalesce("o_max_retries", "max_retries", F.lit(FALLBACK_MAX_RETRIES)).alias("max_retries"),
        F.coalesce("o_min_delay", "min_delay", F.lit(FALLBACK_MIN_DELAY)).alias("min_delay"),
        F.coalesce("o_max_delay", "max_delay", F.lit(FALLBACK_MAX_DELAY)).alias("max_delay"),
    )


def with_policy(df: DataFrame, policy: DataFrame, category_col: str = "error_category") -> DataFrame:
    """Broadcast left join to the (bounded, seven-row) policy table."""
    p = policy.withColumnRenamed("error_category", "_pcat")
    from ..operators.joins import broadcast_bounded
    j = df.join(broadcast_bounded(p), df[category_col] == p["_pcat"], "left").drop("_pcat")
    return (j.withColumn("max_retries", F.coalesce("max_retries", F.lit(FALLBACK_MAX_RETRIES)))
            .withColumn("min_delay", F.coalesce("min_delay", F.lit(FALLBACK_MIN_DELAY)))
            .withColumn("max_delay", F.coalesce("max_delay", F.lit(FALLBACK_MAX_DELAY))))


def should_retry(retry_count, max_retries) -> Column:
    return _c(retry_count) < _c(max_retries)


@dataclass(frozen=True)
class Backoff:
    """How retry delays grow: factor per retry, jitter share, cap in seconds."""
    factor: float = BACKOFF_FACTOR
    jitter: float = JITTER
    cap: float = MAX_RETRY_DELAY


def retry_delay_seconds(retry_count, min_delay, max_delay, jitter_unit=None, backoff: Backoff = Backoff()) -> Column:
    """base * factor^retry, +- jitter, capped (by default 2, 10 %, 3600 s).

    The base is the midpoint of the delay range.  ``jitter_unit`` is a column
    in [-1, 1] (for example from a seeded hash); without it there is no jitter,
    which keeps results deterministic.
    """
    base = (_c(min_delay) + _c(max_delay)) / 2.0
    delay = base * F.pow(F.lit(backoff.factor), _c(retry_count).cast("double"))
    if jitter_unit is not None:
        delay = delay + delay * backoff.jitter * jitter_unit
    return F.least(delay, F.lit(backoff.cap))


def add_seconds(ts, seconds) -> Column:
    """TIMESTAMP_NTZ + fractional seconds (microsecond precision, no time zone)."""
    secs = _c(seconds).cast("decimal(18,6)")
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def next_retry_at(last_failed_at, retry_count, min_delay, max_delay, jitter_unit=None,
                  backoff: Backoff = Backoff()) -> Column:
    return add_seconds(last_failed_at, retry_delay_seconds(retry_count, min_delay, max_delay, jitter_unit, backoff))


def linear_retry_delay(attempt) -> Column:
    """Fetch-level wait before the next attempt: mid base * (attempt + 1)."""
    return (FETCH_MIN_DELAY + FETCH_MAX_DELAY) / 2.0 * (_c(attempt) + 1)


def seeded_jitter(key, seed: int = 0) -> Column:
    """Deterministic pseudo-random number in [-1, 1] from a key."""
    h = F.xxhash64(_c(key), F.lit(seed))
    return (F.pmod(h, F.lit(2000001)).cast("double") - 1000000.0) / 1000000.0
