"""Streaming pipelines.

Sources are file (or Kafka) streams; sinks are idempotent per micro-batch:
``foreachBatch`` writes batch ``n`` to its own folder (re-running batch ``n``
after a failure overwrites the same folder).  Values seen before are keyed
state in the state store; tables of one row for each key are changed bucket by
bucket (``KeyedTable``); the state machines, whose results depend on the order
of events, are kept as summaries by key and time bucket (``EventLog``).
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import errors as E
from ..operators import failures as FL
from ..operators import rates as RT
from ..operators import retries as R
from ..operators.articles import clean_articles
from ..operators.scan import epoch_micros, ntz_from_micros
from ..session import ship_package
from ..sources.keyed_table import KeyedTable
from .eventlog import DAY, EventLog


def ntz_to_instant(col):
    """TIMESTAMP_NTZ -> TIMESTAMP read as UTC, whatever the session time zone
    (watermarks and event-time windows need TIMESTAMP)."""
    return F.timestamp_micros(epoch_micros(col))


def instant_to_ntz(col):
    """TIMESTAMP -> TIMESTAMP_NTZ wall clock in UTC (inverse of ``ntz_to_instant``)."""
    micros = F.unix_micros(col if not isinstance(col, str) else F.col(col))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1000000).cast("decimal(18,6)"))


def file_stream(spark: SparkSession, folder: str, schema, file_glob: str | None = None,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


FILES_PER_TRIGGER = 64


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of part
    files; a micro-batch reads at most ``max_files_per_trigger`` of them."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    table = spark.read.parquet(path)
    one_file = all(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()[:1])
    if one_file and table.inputFiles():
        return file_stream(spark, sf_dir, table.schema, f"{name}.parquet", max_files_per_trigger)
    return file_stream(spark, path, table.schema, None, max_files_per_trigger)


def run_available_now(df: DataFrame, checkpoint: str, batch_fn: Callable[[DataFrame, int], None],
                      output_mode: str = "append") -> None:
    """Process everything available, batch by batch, then stop."""
    q = (df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
         .foreachBatch(batch_fn).trigger(availableNow=True).start())
    q.awaitTermination()


def batch_folder_writer(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink writing batch n to ``path/batch=n`` (overwrite: idempotent on replay)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")
    return write


# ------------------------------------------------------------ stateless

def parse_message_stream(messages: DataFrame, schema: str, value_col: str = "value") -> DataFrame:
    """Decode JSON messages; drop blank payloads and messages without a url/key field."""
    v = F.col(value_col).cast("string")
    return (messages.filter(F.trim(v) != "").withColumn("message", F.from_json(v, schema))
            .filter(F.col("message").isNotNull()))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """Each value of ``key`` once, however often and in whichever micro-batches
    it comes.  The values seen are keyed state, kept on disk by RocksDB: a
    micro-batch looks up its own values and reads no earlier output."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.dropDuplicates([key])


def article_ingest(articles: DataFrame, out_path: str, checkpoint: str, site_col: str = "site") -> None:
    """Parse -> clean -> drop URLs seen before -> append."""
    run_available_now(first_of(clean_articles(articles, site_col), "url"), checkpoint, batch_folder_writer(out_path))


def new_links_stream(links: DataFrame, existing: DataFrame, out_path: str, checkpoint: str,
                     link_col: str = "link") -> None:
    """Incoming links minus stored URLs, each new link once."""
    stored = existing.select(F.col(existing.columns[0]).alias(link_col))
    fresh = links.select(link_col).join(stored, link_col, "left_anti")
    run_available_now(first_of(fresh, link_col), checkpoint, batch_folder_writer(out_path))


FAILED_SCHEMA = ("url_key string, url string, reason string, status_code string, failed_time timestamp_ntz, "
                 "retry_count int, created_at timestamp_ntz")


def failed_table(spark: SparkSession, path: str, n_buckets: int = 16) -> KeyedTable:
    """The stored failed-URL table."""
    return KeyedTable(spark, path, "url_key", FAILED_SCHEMA, n_buckets)


def failed_upsert_stream(failures: DataFrame, table_path: str, checkpoint: str, n_buckets: int = 16) -> None:
    """Running failed-URL table: a micro-batch reads the stored rows of its own
    keys, and writes the rows that it changes."""
    table = failed_table(failures.sparkSession, table_path, n_buckets)

    def batch_fn(batch: DataFrame, batch_id: int) -> None:
        if not table.committed(batch_id):
            stored = table.read_for(batch.select(FL.url_key().alias("url_key")))
            table.commit(FL.failed_upsert(stored, batch), batch_id)

    run_available_now(failures, checkpoint, batch_fn)


def failed_delete(table: KeyedTable, processed: DataFrame) -> None:
    """Delete processed URLs (exact URL match) from the stored table."""
    urls = processed.select(F.col(processed.columns[0]).alias("url")).distinct()
    keys = urls.select(FL.url_key().alias("url_key"))
    found = table.read_for(keys).join(urls, "url", "left_semi")
    table.commit(found.withColumn("_gone", F.lit(True)))


def additive_counts(events: DataFrame, ts: str, keys, window: str, slide: str | None, out_path: str,
                    checkpoint: str) -> None:
    """Counts per (window, keys) of each micro-batch, written as partial sums
    (``summed_counts`` adds them up): no state, and an event counts however
    late it comes."""
    w = F.window("_et", window, slide) if slide else F.window("_et", window)

    def batch_fn(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
        part.select(instant_to_ntz(F.col("w.start")).alias("window_start"),
                    instant_to_ntz(F.col("w.end")).alias("window_end"), *keys, "n") \
            .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    run_available_now(events.select(ntz_to_instant(F.col(ts)).alias("_et"), *keys), checkpoint, batch_fn)


def summed_counts(spark: SparkSession, path: str, keys) -> DataFrame:
    return spark.read.parquet(path).groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"))


# ---------------------------------------------------- keyed state machines

REQUEST_LOG = ("domain string, t bigint, event_id bigint, success boolean, double boolean, domain_delay double")


def _micros(interval: str) -> int:
    """'60 days', '90 minutes' -> microseconds."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": DAY}[unit.rstrip("s")] * 1_000_000


def domain_log(path: str, bucket: str = "1 day", retention: str = "60 days") -> EventLog:
    return EventLog(path, "domain", T.StructType.fromDDL(REQUEST_LOG),
                    lambda rows: RT.request_stretches(rows, ("domain", "bucket")), _micros(bucket), _micros(retention))


def domain_state_stream(fetches: DataFrame, delays: DataFrame, out_path: str, checkpoint: str,
                        bucket: str = "1 day", retention: str = "60 days") -> None:
    """Adaptive delay and throttle per domain, kept as summaries of its requests
    in time buckets (``domain_state`` reads them)."""
    log = domain_log(out_path, bucket, retention)
    run_available_now(RT.request_log(fetches, delays), checkpoint, log.append)


def domain_state(spark: SparkSession, path: str) -> DataFrame:
    """State of each domain after all events of the stream; ``late`` counts the
    events that came too late to be applied."""
    log = domain_log(path)
    states = RT.domain_states(log.summaries(spark))
    return (states.join(log.late(spark), "domain", "left")
            .withColumn("late", F.coalesce("late", F.lit(0)).cast("long")))


FETCH_LOG = ("url string, t bigint, event_id bigint, success boolean, site string, status_code int, "
             "error_category string, error_message string, max_retries int, min_delay double, max_delay double")
_TASK = ("count: int, site: string, first: bigint, category: string, message: string, status: int, last: bigint, "
         "planned: bigint")
TASK_SCHEMA = f"url string, pending struct<{_TASK}>, permanent struct<{_TASK}>"


def _read_fetch_stretches(most: int):
    """Rows sorted by (url, bucket, time) -> one row for each run of rows of a
    URL and bucket."""
    def run(batches):
        key, stretch, at, piece = None, None, None, 0

        def done():
            return pa.RecordBatch.from_pydict(
                {"url": pa.array([key[0]], pa.string()), "bucket": pa.array([key[1]], pa.int64()),
                 "first_at": pa.array([at[0]], pa.int64()), "first_id": pa.array([at[1]], pa.int64()),
                 "piece": pa.array([piece], pa.int64()), "summary": pa.array([R.encode(stretch.summary())], pa.string())})

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:2] != key:
                    if stretch is not None:
                        yield done()
                        piece += 1
                    key, at, stretch = row[:2], row[2:4], R.Stretch(most)
                t, _, ok, site, status, category, message, limit, low, high = row[2:]
                stretch.add(t, bool(ok), site, status, category, message, limit, low, high)
        if stretch is not None:
            yield done()

    return run


def fetch_stretches(log: DataFrame, most: int) -> DataFrame:
    """The log cut into stretches, each summarised as a map (``retries``).  One
    row for each run of a URL and bucket that a task reads."""
    ship_package(log.sparkSession)
    by = ["url", "bucket", "t", "event_id"]
    rows = log.repartitionByRange(*by).sortWithinPartitions(*by, "success", "error_category", "error_message").select(
        *by, "success", "site", "status_code", "error_category", "error_message", "max_retries", "min_delay", "max_delay")
    return rows.mapInArrow(_read_fetch_stretches(most), "url string, bucket bigint, first_at bigint, first_id bigint, "
                                                        "piece bigint, summary string")


def _tasks_of(pdf: pd.DataFrame) -> pd.DataFrame:
    state = R.START
    for text in pdf.sort_values(["first_at", "first_id", "piece"])["summary"]:
        state = R.apply(R.decode(text), state)
    row = {name: None if task is None else dict(zip(("count", *R.FIELDS), task))
           for name, task in zip(("pending", "permanent"), state)}
    return pd.DataFrame([{"url": pdf["url"].iloc[0], **row}], dtype=object)


def url_states(stretches: DataFrame) -> DataFrame:
    """(url, pending, permanent); the rows of a URL are its stretches."""
    return stretches.select("url", "first_at", "first_id", "piece", "summary").groupBy("url").applyInPandas(
        _tasks_of, TASK_SCHEMA)


def failure_log(path: str, policy: DataFrame | None = None, bucket: str = "1 day", retention: str = "60 days") -> EventLog:
    most = E.FALLBACK_MAX_RETRIES if policy is None else max(
        E.FALLBACK_MAX_RETRIES, policy.agg(F.max("max_retries")).first()[0] or 0)
    return EventLog(path, "url", T.StructType.fromDDL(FETCH_LOG), lambda rows: fetch_stretches(rows, most),
                    _micros(bucket), _micros(retention))


def task_table(spark: SparkSession, path: str, n_buckets: int = 16) -> KeyedTable:
    """(url, pending, permanent) of every URL that has a task."""
    return KeyedTable(spark, f"{path}/tasks", "url", TASK_SCHEMA, n_buckets)


def failure_state_stream(fetches: DataFrame, policy: DataFrame, out_path: str, checkpoint: str,
                         bucket: str = "1 day", retention: str = "60 days", n_buckets: int = 16) -> None:
    """Retry lifecycle per URL, with the retries that fall due.

    The stream's clock is its newest event time.  A micro-batch brings the
    tasks of the URLs that it touched up to date; where that plans a retry, the
    plan is set as a timer under its day.  The batch whose clock reaches a timer
    gives it out (``due_retries``) if the task is still planned for that time.
    Timers of other days are not read.
    """
    spark = fetches.sparkSession
    log, table = failure_log(out_path, policy, bucket, retention), task_table(spark, out_path, n_buckets)
    events = FL.failure_events(fetches.filter(F.col("ts").isNotNull()), policy).withColumn("t", epoch_micros("ts")) \
        .withColumn("event_id", F.coalesce(F.col("event_id").cast("long"), F.lit(0)))

    def batch_fn(batch: DataFrame, batch_id: int) -> None:
        touched = log.append(batch, batch_id)
        before, after = log.clock(spark, batch_id)[0], log.clock(spark, batch_id + 1)[0]
        if not table.committed(batch_id):
            changed = f"{out_path}/changed"
            url_states(log.summaries(spark, touched, batch_id)).write.mode("overwrite").parquet(changed)
            now = spark.read.schema(TASK_SCHEMA).parquet(changed)
            old = table.read_for(touched).select("url", F.col("pending.planned").alias("was"))
            plans = (now.join(old, "url", "left").filter("pending is not null and not (pending.planned <=> was)")
                     .select("url", F.col("pending.planned").alias("planned")))
            plans.withColumn("day", F.expr(f"planned div {DAY * 1_000_000}")) \
                .write.mode("overwrite").partitionBy("day").parquet(f"{out_path}/timers/batch={batch_id}")
            gone = F.col("pending").isNull() & F.col("permanent").isNull()
            table.commit(now.withColumn("_gone", gone), batch_id)
        timers = spark.read.schema("url string, planned bigint, batch bigint, day bigint").parquet(f"{out_path}/timers")
        timers = timers.filter((F.col("batch") <= batch_id) & (F.col("planned") <= F.lit(after)))
        if before is not None:  # reached since, or set by this batch
            passed = (F.col("day") >= before // (DAY * 1_000_000)) & (F.col("planned") > before)
            timers = timers.filter(passed | (F.col("batch") == batch_id))
        timers = timers.select("url", "planned").distinct()
        tasks = table.read_for(timers).select("url", "pending.*")
        tasks.join(timers, ["url", "planned"], "left_semi") \
            .write.mode("overwrite").parquet(f"{out_path}/due/batch={batch_id}")

    run_available_now(events, checkpoint, batch_fn)


def _task_columns(name: str):
    t = F.col(name)
    return [F.lit(name).alias("state"), "url", t["site"].alias("site_name"), t["category"].alias("error_category"),
            t["message"].alias("error_message"), t["status"].alias("status_code"), t["count"].alias("retry_count"),
            ntz_from_micros(t["first"]).alias("first_failed_at"), ntz_from_micros(t["last"]).alias("last_failed_at"),
            ntz_from_micros(t["planned"]).alias("next_retry_at")]


def current_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks after all events of the stream.  ``due``: the stream has given the
    planned retry out; ``late`` counts the URL's events that came too late."""
    tasks = task_table(spark, path).read()
    rows = tasks.filter("pending is not null").select(*_task_columns("pending")).unionByName(
        tasks.filter("permanent is not null").select(*_task_columns("permanent")))
    given = due_retries(spark, path).select("url", "next_retry_at", F.lit("pending").alias("state"),
                                            F.lit(True).alias("due")).distinct()
    return (rows.join(given, ["url", "next_retry_at", "state"], "left").withColumn("due", F.coalesce("due", F.lit(False)))
            .join(failure_log(path).late(spark), "url", "left")
            .withColumn("late", F.coalesce("late", F.lit(0)).cast("long")))


def due_retries(spark: SparkSession, path: str) -> DataFrame:
    """Retries given out as they fell due: (url, retry_count, next_retry_at,
    batch), one row for each time that a task has been planned for."""
    t = spark.read.parquet(f"{path}/due")
    return t.select("url", F.col("count").alias("retry_count"), ntz_from_micros("planned").alias("next_retry_at"), "batch")


SEQUENCE_BUCKET = 1024


def _bucket_changes(rows: DataFrame) -> DataFrame:
    """Of each page's observations in a bucket: the first, the last, and those
    that differ from the one before."""
    w = Window.partitionBy("page_key", "bucket").orderBy("t", "content_hash")
    d = rows.withColumn("prev", F.lag("content_hash").over(w)).withColumn("place", F.row_number().over(w))
    d = d.withColumn("is_last", F.lead("t").over(w).isNull()).withColumn("is_first", F.col("place") == 1)
    d = d.withColumn("changed", ~F.col("is_first") & ~F.col("prev").eqNullSafe(F.col("content_hash")))
    return d.filter("is_first or is_last or changed").select(
        "page_key", "bucket", "t", "content_hash", "is_first", "is_last", "changed")


def content_log(path: str, key_type: str = "bigint", bucket: int = SEQUENCE_BUCKET) -> EventLog:
    schema = T.StructType.fromDDL(f"page_key {key_type}, t bigint, content_hash string")
    return EventLog(path, "page_key", schema, _bucket_changes, bucket, None)


def content_change_stream(observations: DataFrame, key: str, seq: str, text: str, out_path: str,
                          checkpoint: str, bucket: int = SEQUENCE_BUCKET) -> None:
    """Observations of pages, in any order; a micro-batch derives anew only the
    runs of ``bucket`` sequence numbers that it adds to.  Observations without a
    sequence number have no place in the order and are left out."""
    o = observations.filter(F.col(seq).isNotNull()).select(
        F.col(key).alias("page_key"), F.col(seq).cast("long").alias("t"), F.md5(F.col(text)).alias("content_hash"))
    log = content_log(out_path, o.schema["page_key"].dataType.simpleString(), bucket)
    run_available_now(o, checkpoint, log.append)


def content_changes(spark: SparkSession, path: str) -> DataFrame:
    """Observations that differ from the one before (the first included): those
    found inside the buckets, and the first of a bucket where the last of the
    bucket before differs.  Only a bucket's first and last are put in order."""
    rows = content_log(path).summaries(spark)
    ends = rows.groupBy("page_key", "bucket").agg(
        F.max(F.when(F.col("is_first"), F.struct("t", "content_hash"))).alias("first"),
        F.max(F.when(F.col("is_last"), F.struct("content_hash"))).alias("last"))
    w = Window.partitionBy("page_key").orderBy("bucket")
    ends = ends.withColumn("before", F.lag("last").over(w))
    opening = ends.filter(F.col("before").isNull() | ~F.col("before.content_hash").eqNullSafe(F.col("first.content_hash")))
    inside = rows.filter("changed").select("page_key", "t", "content_hash")
    return inside.unionByName(opening.select("page_key", "first.*")).withColumnRenamed("t", "seq")


def publish_stream(rows: DataFrame, checkpoint: str, servers: str | None = None, path: str | None = None,
                   trigger_seconds: int | None = None):
    """Publish streaming (topic, key, value) rows: to Kafka when ``servers`` is
    given (acks=all), else as JSON files partitioned by topic."""
    w = rows.writeStream.option("checkpointLocation", checkpoint)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    if servers:
        return (w.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all")
                .start())
    return w.format("json").partitionBy("topic").option("path", path).start()


# ------------------------------------------------------------ stream sinks

def failed_csv_stream(failures: DataFrame, path: str, checkpoint: str) -> None:
    """Append failed URLs to CSV (header per file), one folder per micro-batch."""
    from ..sources.sinks import write_failed_csv

    def batch_fn(batch: DataFrame, batch_id: int) -> None:
        write_failed_csv(batch, f"{path}/batch={batch_id}")

    run_available_now(failures, checkpoint, batch_fn)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Fetcher log lines as a stream (new files in ``folder``), parsed like ``log_lines``."""
    from ..sources.readers import LOG_RE, LOG_TS_FORMAT
    t = spark.readStream.text(folder)
    ts = F.regexp_extract("value", LOG_RE, 1)
    return t.select(F.to_timestamp_ntz(ts, F.lit(LOG_TS_FORMAT)).alias("log_time"),
                    F.regexp_extract("value", LOG_RE, 2).alias("logger"),
                    F.regexp_extract("value", LOG_RE, 3).alias("level"),
                    F.regexp_extract("value", LOG_RE, 4).alias("message"), F.col("value").alias("line"))
