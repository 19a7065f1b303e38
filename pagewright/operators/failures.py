"""Failed-URL table, retry lifecycle and failure statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.text import reason_preview
from .joins import contains_like_join
from .scan import bucketed_prefix, range_chunks

URL_KEY_CHARS = 255
FAILED_RETRY_LIMIT = 3


def failure_record(fetches: DataFrame) -> DataFrame:
    """Failed fetches as failed-URL rows (url, reason, status_code, failed_time).

    The status text is the HTTP status when there is one, ``Exception`` for a
    raised error without a status, ``Unknown`` otherwise.
    """
    f = fetches.filter(~F.col("success"))
    status = (F.when(F.col("status_code").isNotNull(), F.col("status_code").cast("string"))
              .when(F.col("error_name").isNotNull(), F.lit("Exception"))
              .otherwise(F.lit("Unknown")))
    reason = F.concat(F.coalesce("error_name", F.lit("HTTPError")), F.lit(" while fetching "), "url",
                      F.lit(" (event "), F.col("event_id").cast("string"), F.lit(", props "),
                      F.coalesce("props", F.lit("")), F.lit(")"))
    return f.select("event_id", "url", reason.alias("reason"), status.alias("status_code"),
                    F.col("ts").alias("failed_time"))


def url_key(col: str = "url"):
    return F.left(F.col(col), F.lit(URL_KEY_CHARS))


def failed_upsert(snapshot: DataFrame | None, batch: DataFrame, order=("failed_time", "event_id")) -> DataFrame:
    """Apply a batch of failures to the failed-URL snapshot (insert or update).

    Key = first 255 characters of the URL.  A new key is inserted with
    retry_count 0 and every further row adds one; an existing key adds the
    number of rows.  Reason, status and time come from the key's last row; the
    stored URL text is the first one seen.  The batch is pre-aggregated per key
    (partial aggregation before the shuffle) and then full-outer-joined with
    the snapshot, so a hot key costs one row after the map side.
    """
    o = F.struct(*[F.col(c) for c in order])
    b = (batch.withColumn("url_key", url_key()).groupBy("url_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("url", o).alias("b_url"),
        F.max_by(F.struct("reason", "status_code", "failed_time"), o).alias("b_last"),
        F.min("failed_time").alias("b_first")))
    if snapshot is None:
        return b.select("url_key", F.col("b_url").alias("url"), "b_last.reason", "b_last.status_code",
                        "b_last.failed_time", (F.col("n") - 1).cast("int").alias("retry_count"),
                        F.col("b_first").alias("created_at"))
    s = snapshot.select("url_key", F.col("url").alias("s_url"), F.col("reason").alias("s_reason"),
                        F.col("status_code").alias("s_status"), F.col("failed_time").alias("s_time"),
                        F.col("retry_count").alias("s_rc"), F.col("created_at").alias("s_created"))
    j = s.join(b, "url_key", "full")
    new = F.col("s_url").isNull()
    # rows may come in any order: the newest failure describes the key, the oldest names it
    newer = F.col("n").isNotNull() & (new | (F.col("b_last.failed_time") >= F.col("s_time")))
    older = F.col("n").isNotNull() & (new | (F.col("b_first") < F.col("s_created")))
    return j.select(
        "url_key",
        F.when(older, F.col("b_url")).otherwise(F.col("s_url")).alias("url"),
        F.when(newer, F.col("b_last.reason")).otherwise(F.col("s_reason")).alias("reason"),
        F.when(newer, F.col("b_last.status_code")).otherwise(F.col("s_status")).alias("status_code"),
        F.when(newer, F.col("b_last.failed_time")).otherwise(F.col("s_time")).alias("failed_time"),
        F.when(new, F.col("n") - 1).otherwise(F.col("s_rc") + F.coalesce("n", F.lit(0)))
        .cast("int").alias("retry_count"),
        F.when(older, F.col("b_first")).otherwise(F.col("s_created")).alias("created_at"))


def failed_retryable(failed: DataFrame, limit: int = FAILED_RETRY_LIMIT) -> DataFrame:
    return failed.filter(F.col("retry_count") < limit)


def failed_remove(failed: DataFrame, processed: DataFrame) -> DataFrame:
    """Delete processed URLs (exact URL match) from the failed table."""
    p = processed.select(F.col(processed.columns[0]).alias("url")).distinct()
    return failed.join(p, "url", "left_anti")


def failed_removed(failed: DataFrame, processed: DataFrame) -> DataFrame:
    """The rows that ``failed_remove`` deletes (its 'found' report)."""
    p = processed.select(F.col(processed.columns[0]).alias("url")).distinct()
    return failed.join(p, "url", "left_semi")


def failed_for_site(failed: DataFrame, sites: DataFrame, limit: int = 10,
                    retry_limit: int = FAILED_RETRY_LIMIT) -> DataFrame:
    """Per site: retryable failed URLs whose text contains the site name, newest first.

    Case-insensitive LIKE '%site%' (``_`` is a wildcard, as in the source
    database), joined without forming all pairs (``contains_like_join``);
    the per-site top ``limit`` is a row_number limit that Spark applies
    partially before the shuffle.
    """
    s = sites.select("site").distinct()
    j = contains_like_join(failed_retryable(failed, retry_limit), "url", s, "site")
    w = Window.partitionBy("site").orderBy(F.desc("failed_time"), "url_key")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def failed_queue_head(failed: DataFrame, limit: int = 10, retry_limit: int = FAILED_RETRY_LIMIT) -> DataFrame:
    return failed_retryable(failed, retry_limit).orderBy(F.desc("failed_time"), "url_key").limit(limit)


def recent_failures(failed: DataFrame, limit: int = 10) -> DataFrame:
    return (failed.orderBy(F.desc("failed_time"), "url_key").limit(limit)
            .select("url", reason_preview("reason").alias("reason"), "status_code",
                    F.date_format("failed_time", "yyyy-MM-dd HH:mm:ss").alias("failed_time"),
                    "retry_count"))


def retry_success_semi(failed: DataFrame, fetches: DataFrame) -> DataFrame:
    """Failed URLs that succeeded after their last failure (to be removed)."""
    ok = fetches.filter("success").groupBy("url").agg(F.max("ts").alias("last_ok"))
    return (failed.join(ok, "url").filter(F.col("last_ok") > F.col("failed_time"))
            .select(*failed.columns))


def attempt_outcome(fetches: DataFrame, max_attempts: int = E.FETCH_MAX_RETRIES) -> DataFrame:
    """Per URL: only the first ``max_attempts`` attempts count.

    Success if one of them succeeded (attempts stop at the first success),
    else one failure; retries = attempts - 1.
    """
    w = Window.partitionBy("url").orderBy("ts", "event_id")
    first = fetches.withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= max_attempts)
    g = first.groupBy("url").agg(
        F.bool_or("success").alias("success"),
        F.min(F.when(F.col("success"), F.col("attempt"))).alias("_first_ok"),
        F.count(F.lit(1)).alias("_n"))
    attempts = F.coalesce(F.col("_first_ok"), F.col("_n")).cast("int")
    return g.select("url", "success", attempts.alias("attempts"), (attempts - 1).alias("retries"))


def dedup_latest(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the newest wins.  ``max_by`` aggregates map-side first."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


# ---------------------------------------------------------------- lifecycle

def failure_events(fetches: DataFrame, policy: DataFrame) -> DataFrame:
    """Fetch log -> lifecycle events: failures carry their category and policy."""
    cat = E.classify_error("error_name", "status_code")
    msg = F.concat_ws(": ", F.coalesce("error_name", F.lit("HTTPError")), F.col("status_code").cast("string"))
    ev = fetches.select("url", "site", "ts", "event_id", "success", "status_code",
                        F.when(~F.col("success"), cat).alias("error_category"),
                        F.when(~F.col("success"), msg).alias("error_message"))
    return E.with_policy(ev, policy)


def _retry_steps(events: Column, most: int) -> Column:
    """For each start (no pending task: -1, else its retry count up to ``most``
    - 1) the end after a chunk's events, and the chunk's last failure that
    stopped retrying: an array of (rc, gone, gone_rc)."""
    def step(acc, x):
        rc = acc["rc"] + 1
        stop = ~x["success"] & (rc >= x["max_retries"])
        return F.struct(F.when(x["success"] | stop, F.lit(-1)).otherwise(rc).alias("rc"),
                        F.when(stop, x["seq"]).otherwise(acc["gone"]).alias("gone"),
                        F.when(stop, rc).otherwise(acc["gone_rc"]).alias("gone_rc"))

    return F.transform(F.sequence(F.lit(-1), F.lit(max(most - 1, -1))), lambda start: F.aggregate(
        events, F.struct(start.alias("rc"), F.lit(None).cast("long").alias("gone"),
                         F.lit(None).cast("int").alias("gone_rc")), step))


def failure_lifecycle(fetches: DataFrame, policy: DataFrame, n_chunks: int | None = None,
                      backoff: E.Backoff = E.Backoff(), jitter_seed: int | None = None) -> DataFrame:
    """Replay register_failure / mark_task_success per URL in time order.

    Result: one row per task left, ``state`` = 'pending' or 'permanent'.
    A new failure opens a pending task (retry_count 0); a repeat adds one;
    past the category's limit the task becomes permanent (a later failure
    opens a fresh pending task); a success removes the pending task.

    The retry count is all that one failure passes on to the next, and it has
    few values.  So each chunk of a URL's events is summarised for every count
    it may start with, the summaries of a URL are applied one after the other,
    and the tasks that are left are looked up by the numbers of their failures:
    a fixed number of jobs, however many chunks a URL has.  ``backoff`` sets how
    delays grow; with ``jitter_seed`` they are jittered by a hash of the URL.
    """
    ev = range_chunks(failure_events(fetches, policy), ["url"], ["ts", "event_id"], n_chunks)
    ev = bucketed_prefix(ev, ["url"], ["ts", "event_id"], F.col("_chunk"), "seq",
                         F.when(F.col("success"), 0).otherwise(1))
    most = ev.agg(F.max("max_retries")).first()[0] or 0
    events = F.array_sort(F.collect_list(F.struct("ts", "event_id", "success", "max_retries", "seq")))
    chunks = ev.groupBy("url", "_chunk").agg(events.alias("e"), F.max("seq").alias("last"))
    chunks = chunks.select("url", F.struct("_chunk", "last", _retry_steps(F.col("e"), most).alias("steps")).alias("c"))
    zero = F.struct(F.lit(-1).alias("rc"), F.lit(None).cast("long").alias("gone"),
                    F.lit(None).cast("int").alias("gone_rc"), F.lit(0).cast("long").alias("last"))

    def follow(acc, c):
        end = F.element_at(c["steps"], acc["rc"] + 2)
        return F.struct(end["rc"].alias("rc"), F.coalesce(end["gone"], acc["gone"]).alias("gone"),
                        F.when(end["gone"].isNotNull(), end["gone_rc"]).otherwise(acc["gone_rc"]).alias("gone_rc"),
                        F.greatest(acc["last"], c["last"]).alias("last"))

    # one small row per chunk of a URL
    per_url = chunks.groupBy("url").agg(F.aggregate(F.array_sort(F.collect_list("c")), zero, follow).alias("s"))
    left = per_url.select("url", F.explode(F.array(
        F.struct(F.lit("pending").alias("state"), F.col("s.last").alias("seq"), F.col("s.rc").alias("rc")),
        F.struct(F.lit("permanent").alias("state"), F.col("s.gone").alias("seq"), F.col("s.gone_rc").alias("rc"))))
        .alias("t")).filter((F.col("t.rc") >= 0) & F.col("t.seq").isNotNull())
    # the failures that opened the task, came before the last one, and were the last
    needs = left.select("url", "t.*", F.explode(F.array(
        F.struct(F.lit("first").alias("part"), (F.col("t.seq") - F.col("t.rc")).alias("at")),
        F.struct(F.lit("before").alias("part"), F.when(F.col("t.rc") > 0, F.col("t.seq") - 1).alias("at")),
        F.struct(F.lit("last").alias("part"), F.col("t.seq").alias("at")))).alias("n"))
    failures = ev.filter(~F.col("success")).select(
        "url", F.col("seq").alias("at"), F.struct("site", "ts", "status_code", "error_category", "error_message",
                                                  "min_delay", "max_delay").alias("f"))
    found = needs.select("url", "state", "rc", "n.part", "n.at").filter(F.col("at").isNotNull()).join(
        failures, ["url", "at"])
    of = {p: F.max(F.when(F.col("part") == p, F.col("f"))).alias(p) for p in ("first", "before", "last")}
    task = found.groupBy("url", "state", "rc").agg(*of.values())
    # a task that stops retrying keeps its last planned time
    unit = None if jitter_seed is None else E.seeded_jitter("url", jitter_seed)
    planned = F.when(F.col("state") == "pending", E.next_retry_at(
        F.col("last.ts"), F.col("rc"), F.col("last.min_delay"), F.col("last.max_delay"), unit, backoff)).otherwise(
            E.next_retry_at(F.col("before.ts"), F.col("rc") - 1, F.col("before.min_delay"),
                            F.col("before.max_delay"), unit, backoff))
    return task.select("state", "url", F.col("first.site").alias("site_name"), "last.error_category",
                       "last.error_message", "last.status_code", F.col("rc").alias("retry_count"),
                       F.col("first.ts").alias("first_failed_at"), F.col("last.ts").alias("last_failed_at"),
                       planned.alias("next_retry_at"))


def all_tasks(snapshot: DataFrame, derived: DataFrame) -> DataFrame:
    """Tasks of a loaded snapshot and of the log since, one for each state and
    URL: the one with the later last failure stands, of equal ones the derived."""
    cols = [c for c in derived.columns if c not in ("state", "url")]
    both = snapshot.select("state", "url", *cols, F.lit(0).alias("_from")).unionByName(
        derived.select("state", "url", *cols, F.lit(1).alias("_from")))
    return dedup_latest(both, ["state", "url"], ["last_failed_at", "_from"]).drop("_from")


def ready_tasks(tasks: DataFrame, now, limit: int = 10) -> DataFrame:
    """Pending tasks due at ``now``, earliest first."""
    return (tasks.filter((F.col("state") == "pending") & (F.col("next_retry_at") <= now))
            .orderBy("next_retry_at", "url").limit(limit))


def for_each_permanent(tasks: DataFrame, callback) -> None:
    """Hand the permanently failed tasks to a user callback (a DataFrame sink);
    in a stream, call it from ``foreachBatch``."""
    callback(tasks.filter(F.col("state") == "permanent"))


def failure_stats_by_category(tasks: DataFrame, policy: DataFrame) -> DataFrame:
    """Pending and permanent counts for every category, zero included."""
    counts = tasks.groupBy("error_category").agg(
        F.count(F.when(F.col("state") == "pending", 1)).alias("pending"),
        F.count(F.when(F.col("state") == "permanent", 1)).alias("permanent"))
    cats = policy.select("error_category")
    return (cats.join(counts, "error_category", "left")
            .select("error_category", F.coalesce("pending", F.lit(0)).alias("pending"),
                    F.coalesce("permanent", F.lit(0)).alias("permanent")))


def failure_stats_by_site(tasks: DataFrame) -> DataFrame:
    return (tasks.groupBy("site_name").pivot("state", ["pending", "permanent"]).count()
            .na.fill(0, ["pending", "permanent"]))


def format_task_times(tasks: DataFrame) -> DataFrame:
    """Times as 'yyyy-MM-dd HH:mm:ss' strings, as the snapshot file keeps them."""
    out = tasks
    for c in ("first_failed_at", "last_failed_at", "next_retry_at"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


def extra_data_merge(updates: DataFrame, key: str = "url", order=("ts", "event_id")) -> DataFrame:
    """Key/value data merged over repeated failures, newest value per key wins.

    ``updates`` has ``key``, the order columns and a map column ``extra_data``.
    Returned as rows (key, name, value): the per-name ``max_by`` aggregates
    map-side, so a URL with many failures never becomes one large map in one task.
    """
    o = F.struct(*[F.col(c) for c in order])
    kv = updates.select(key, *order, F.explode("extra_data").alias("name", "value"))
    return kv.groupBy(key, "name").agg(F.max_by("value", o).alias("value"))
