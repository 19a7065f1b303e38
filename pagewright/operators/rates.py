"""Per-domain request pacing: delays, gaps, trailing rates, throttling."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_domain
from ..session import ship_package
from ..sources.site_config import DEFAULT_DOMAIN_DELAY
from . import pacing as P
from .joins import broadcast_bounded
from .scan import bucketed_lag, bucketed_prefix, epoch_micros, ntz_from_micros, range_chunks, time_bucket, \
    trailing_count

# Pacing defaults of the rate limiter class (delays and blocks: ``pacing``).
GLOBAL_RATE_LIMIT, GLOBAL_WINDOW_SECONDS = 10, 60
# Health-check alarm threshold (consecutive failed checks).
HEALTH_ALARM_THRESHOLD = 3


def site_domain_delays(sites: DataFrame) -> DataFrame:
    """Configured delay per domain: the domain of the site's first start URL,
    only for sites that set a delay; on a repeated domain the later site wins."""
    first = F.try_element_at("start_urls", F.lit(1)) if "start_urls" in sites.columns else F.col("start_url")
    order = F.col("ord") if "ord" in sites.columns else F.col("site_id")
    return (sites.filter(F.col("domain_delay").isNotNull())
            .select(url_domain(first).alias("domain"), "domain_delay", order.alias("_ord"))
            .groupBy("domain").agg(F.max_by("domain_delay", "_ord").alias("domain_delay")))


def domain_delay_lookup(df: DataFrame, delays: DataFrame, default: float = DEFAULT_DOMAIN_DELAY,
                        domain_col: str = "domain") -> DataFrame:
    d = delays.withColumnRenamed("domain", domain_col)
    return (df.join(broadcast_bounded(d), domain_col, "left")
            .withColumn("domain_delay", F.coalesce("domain_delay", F.lit(default))))


def request_gap_wait(fetches: DataFrame, delays: DataFrame, n_chunks: int | None = None) -> DataFrame:
    """Wait needed before each request = max(0, delay - seconds since the
    previous request to the same domain); 0 for a domain's first request.

    ``delay`` is the domain's configured delay (default 3 s).  The adaptive
    delay the pacing also takes into account is the state of
    ``domain_delay_fold``.

    The input is materialised once in row-bounded chunks; pass only the
    columns you need (a checkpoint does not prune columns afterwards).
    """
    d = range_chunks(domain_delay_lookup(fetches, delays), ["domain"], ["ts", "event_id"], n_chunks)
    d = bucketed_lag(d, ["domain"], ["ts", "event_id"], F.col("_chunk"), ["ts"]).drop("_chunk")
    gap = (epoch_micros("ts") - epoch_micros("prev_ts")) / 1000000.0
    wait = F.when(F.col("has_prev"), F.greatest(F.lit(0.0), F.col("domain_delay") - gap)).otherwise(F.lit(0.0))
    return d.withColumn("wait_seconds", wait)


def trailing_request_rate(fetches: DataFrame, limit: int = GLOBAL_RATE_LIMIT,
                          window_seconds: int = GLOBAL_WINDOW_SECONDS, by=("domain",),
                          n_chunks: int | None = None) -> DataFrame:
    """Requests in the trailing window (t - 60 s, t], the over-limit flag and
    the wait until the oldest request leaves the window."""
    d = trailing_count(fetches, list(by), "ts", window_seconds * 1000000, n_chunks)
    over = F.col("n_trailing") > limit
    wait = (epoch_micros("oldest_ts") + window_seconds * 1000000 - epoch_micros("ts")) / 1000000.0
    return d.withColumn("over_limit", over).withColumn("wait_seconds", F.when(over, wait))


def consecutive_failures(fetches: DataFrame, key: str = "domain", threshold: int = P.MAX_FAILURES_BEFORE_THROTTLE,
                         bucket_seconds: int | None = None) -> DataFrame:
    """Length of the failure run ending at each row (0 on a success) and an
    alarm flag once it reaches ``threshold``.

    streak = failures so far - failures up to the last success; both are
    running aggregates, computed bucket-wise.
    """
    order = ["ts", "event_id"]
    if bucket_seconds is None:  # row-bounded chunks (default)
        fetches = range_chunks(fetches, [key], order)
        b = F.col("_chunk")
    else:
        b = time_bucket("ts", bucket_seconds)
    d = bucketed_prefix(fetches, [key], order, b, "_fails",
                        F.when(F.col("success"), 0).otherwise(1), "sum")
    d = bucketed_prefix(d, [key], order, b, "_fails_at_ok",
                        F.when(F.col("success"), F.col("_fails")), "max")
    streak = F.col("_fails") - F.coalesce(F.col("_fails_at_ok"), F.lit(0))
    return (d.withColumn("failure_streak", streak.cast("long"))
            .withColumn("alarm", F.col("failure_streak") >= threshold)
            .drop("_fails", "_fails_at_ok", "_chunk"))


# ------------------------------------------------------------------ folds

_STRETCH = "first_at bigint, first_id bigint, piece bigint, summary string"
_REQUEST = ["t", "event_id", "success", "double", "domain_delay"]


def _read_stretches(keys: list[str]):
    """Rows sorted by (keys, time) -> one row for each run of rows of a key."""
    def run(batches):
        key, stretch, at, piece, kinds = None, None, None, 0, []

        def done():
            values = [*key, *at, piece, P.encode(stretch.summary())]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kind) for v, kind in zip(values, [*kinds, pa.int64(), pa.int64(), pa.int64(), pa.string()])],
                names=[*keys, "first_at", "first_id", "piece", "summary"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            columns = [batch.column(c).to_pylist() for c in [*keys, *_REQUEST]]
            for row in zip(*columns):
                if stretch is None or row[:len(keys)] != key:
                    if stretch is not None:
                        yield done()
                        piece += 1
                    key, stretch, at = row[:len(keys)], P.Stretch(), row[len(keys):len(keys) + 2]
                t, _, ok, double, base = row[len(keys):]
                stretch.add(t, bool(ok), double, base)
        if stretch is not None:
            yield done()

    return run


def request_log(fetches: DataFrame, delays: DataFrame) -> DataFrame:
    """Requests as the pacing rules read them: domain, time in microseconds,
    id, result, whether it counts twice, the domain's configured delay.  Rows
    without a time are no requests."""
    d = domain_delay_lookup(fetches.filter(F.col("ts").isNotNull()), delays)
    double = F.coalesce(F.col("status_code").isin(*P.DOUBLE_FAILURE_STATUSES), F.lit(False))
    return d.select("domain", epoch_micros("ts").alias("t"), F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event_id"),
                    "success", double.alias("double"), "domain_delay")


def request_stretches(log: DataFrame, keys=("domain",), n_chunks: int | None = None) -> DataFrame:
    """The log cut into stretches, each summarised as a map (``pacing``).

    Range partitioning on (keys, time) spreads a hot domain over many tasks;
    each task reads its sorted rows once, in memory of a fixed size, and gives
    one row for every key it meets.
    """
    ship_package(log.sparkSession)
    keys = list(keys)
    by = [F.col(c) for c in [*keys, "t", "event_id"]]
    spread = log.repartitionByRange(n_chunks, *by) if n_chunks else log.repartitionByRange(*by)
    rows = spread.sortWithinPartitions(*by, "success", "double", "domain_delay").select(*keys, *_REQUEST)
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(_read_stretches(keys), f"{types}, {_STRETCH}")


def _replayed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One domain's stretches, applied in order to the state before any request."""
    state, requests, successes = P.START, 0, 0
    for text in pdf.sort_values(["first_at", "first_id", "piece"])["summary"]:
        summary = P.decode(text)
        state = P.apply(summary, state)
        requests += summary["requests"]
        successes += summary["successes"]
    delay, failures, until = state
    return pd.DataFrame({"domain": pdf["domain"].head(1).to_numpy(), "delay": [delay], "failures": [failures],
                         "throttled": [until is not None], "until": pd.array([until], dtype="Int64"),
                         "requests": [requests], "successes": [successes]})


def domain_states(stretches: DataFrame) -> DataFrame:
    """Delay, failure run, block and totals of each domain; the rows of a
    domain are its stretches, one small row a task that met it."""
    out = stretches.select("domain", "first_at", "first_id", "piece", "summary").groupBy("domain").applyInPandas(
        _replayed, "domain string, delay double, failures int, throttled boolean, until bigint, requests bigint, "
                   "successes bigint")
    return out.withColumn("until", ntz_from_micros("until"))


def domain_delay_fold(fetches: DataFrame, delays: DataFrame, n_chunks: int | None = None) -> DataFrame:
    """Adaptive delay per domain after replaying its request results in order.

    success: delay * 0.8 (not below the minimum) once it is positive;
    failure: first the configured delay, then * 2 (not above the maximum);
    403/429/503 count as a second failure.
    """
    states = domain_states(request_stretches(request_log(fetches, delays), n_chunks=n_chunks))
    return states.select("domain", F.col("delay").alias("current_delay"))


def domain_throttle_fold(fetches: DataFrame, delays: DataFrame, n_chunks: int | None = None) -> DataFrame:
    """Delay and throttle state per domain after replaying its request log.

    Five failures in a row block the domain for five minutes; the block's
    expiry is checked before each request and resets the failure count; a
    success alone does not lift the block; 403/429/503 count twice.

    Two shuffles whatever the domains do: the rows once, to stretches in time
    order, and one small row for each stretch.
    """
    return domain_states(request_stretches(request_log(fetches, delays), n_chunks=n_chunks))


def after_reset(fetches: DataFrame, resets: DataFrame) -> DataFrame:
    """Requests that count after statistics have been cleared.

    ``resets`` has ``domain`` (null: all domains) and ``reset_at``; requests up
    to the newest reset that covers their domain are forgotten.
    """
    whole = resets.filter(F.col("domain").isNull()).select(F.max("reset_at")).scalar()
    each = resets.filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.max("reset_at").alias("_own"))
    covered = F.greatest(whole, F.col("_own"))
    return (fetches.join(broadcast_bounded(each), "domain", "left")
            .filter(covered.isNull() | (F.col("ts") > covered)).drop("_own"))


def domain_stats(state: DataFrame, domain: str | None = None) -> DataFrame:
    """Per-domain statistics from the throttle fold; optionally one domain."""
    s = state if domain is None else state.filter(F.col("domain") == domain)
    rate = F.when(F.col("requests") > 0, F.col("successes") * 100.0 / F.col("requests")).otherwise(F.lit(0.0))
    return s.select("domain", F.col("requests").alias("total_requests"),
                    F.col("successes").alias("total_success"), rate.alias("success_rate"),
                    F.col("delay").alias("current_delay"), F.col("throttled").alias("is_throttled"),
                    F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("throttled_until"))
