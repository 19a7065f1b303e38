"""Readers: captured pages, messages, log text, JDBC tables, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import FAILED_TASK_FILE, PAGE

LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured pages (page_id, url, html) with an explicit schema."""
    r = spark.read.schema(PAGE)
    return r.parquet(path) if fmt == "parquet" else r.json(path)


def parse_messages(messages: DataFrame, schema: str, value_col: str = "value") -> DataFrame:
    """JSON payloads -> ``message`` struct; blank payloads become NULL (not an error)."""
    v = F.col(value_col).cast("string")
    return messages.withColumn(
        "message", F.when(F.trim(v) != "", F.from_json(v, schema)))


def read_kafka(spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None,
               stream: bool = True) -> DataFrame:
    """Messages of a topic from the earliest offset; ``max_per_trigger`` bounds
    a micro-batch (none by default).  Needs the Kafka connector on the classpath."""
    r = spark.readStream if stream else spark.read
    r = (r.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
         .option("startingOffsets", "earliest"))
    if stream and max_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_per_trigger)
    return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic",
                           "partition", "offset", "timestamp")


def render_fetch_log(fetches: DataFrame) -> DataFrame:
    """Fetcher log lines for a request log (one ``value`` text column)."""
    msg = F.when(F.col("success"), F.concat(F.lit("Fetched "), "url", F.lit(" status "),
                                            F.col("status_code").cast("string"))).otherwise(
        F.concat(F.lit("Failed to fetch "), "url", F.lit(": "),
                 F.coalesce("error_name", F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))),
                 F.when(F.col("depth") == 2, F.lit(" (retry scheduled)")).otherwise(F.lit(""))))
    level = F.when(F.col("success"), F.lit("INFO")).otherwise(F.lit("ERROR"))
    return fetches.select(F.concat_ws(" - ", F.date_format("ts", LOG_TS_FORMAT), F.lit("fetcher"),
                                      level, msg).alias("value"))


LOG_RE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) - ([^ ]+) - ([A-Z]+) - (.*)$"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log text -> (log_time, logger, level, message, line)."""
    t = spark.read.text(path)
    ts = F.regexp_extract("value", LOG_RE, 1)
    return t.select(
        F.to_timestamp_ntz(ts, F.lit(LOG_TS_FORMAT)).alias("log_time"),
        F.regexp_extract("value", LOG_RE, 2).alias("logger"),
        F.regexp_extract("value", LOG_RE, 3).alias("level"),
        F.regexp_extract("value", LOG_RE, 4).alias("message"),
        F.col("value").alias("line"))


def jdbc_read(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              properties: dict | None = None, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None
              ) -> DataFrame:
    """A table or a SELECT from a SQL database, optionally read in parallel ranges."""
    r = spark.read.format("jdbc").option("url", url)
    r = r.option("query", query) if query else r.option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def read_failure_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Load saved tasks: times parsed back; permanent rows have no next retry."""
    s = spark.read.schema(FAILED_TASK_FILE).json(path)

    def ts(c: str) -> Column:
        return F.to_timestamp_ntz(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss"))

    return s.select(
        "state", "url", "site_name", "error_category", "error_message", "status_code", "retry_count",
        ts("first_failed_at").alias("first_failed_at"), ts("last_failed_at").alias("last_failed_at"),
        F.when(F.col("state") == "pending", ts("next_retry_at")).alias("next_retry_at"), "extra_data")


def read_bulk_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(url, action, source) of a bulk body: records are cut before each action line."""
    mark = '{"index":'
    rec = spark.read.option("lineSep", "\n" + mark).text(path).select(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n").alias("r"))
    head = F.col("r")[0]
    action = F.when(head.startswith(mark), head).otherwise(F.concat(F.lit(mark), head))
    return rec.select(F.get_json_object(F.col("r")[1], "$.url").alias("url"), action.alias("action"),
                      F.col("r")[1].alias("source"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(topic, key, value) rows of a message folder (one sub-folder per topic)."""
    return spark.read.schema("key string, value string, topic string").json(path).select("topic", "key", "value")
