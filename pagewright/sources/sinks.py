"""Sinks: CSV, article table, search-index bulk files, message topics, reports,
failure snapshots, table DDL and retention.

Writers are distributed (one writer per partition); nothing passes through
the driver.  Connectors that are not on the classpath (Kafka, JDBC drivers,
search index) are used when given and otherwise replaced by files of the same
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.articles import prepare_article_rows
from .schemas import ARTICLE_TABLE, FAILED_FETCH

CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, partition_by=(), mode: str = "append") -> None:
    w = df.write.mode(mode).options(**CSV_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_article_csv(articles: DataFrame, path: str) -> None:
    """One CSV folder per site and depth, with a header."""
    # rebalance: a folder gets a few right-sized files, not one per task
    write_csv(articles.hint("rebalance", "site", "depth"), path, partition_by=("site", "depth"))


def write_failed_csv(failures: DataFrame, path: str) -> None:
    """Append failed URLs (url, reason, status_code, failed_time) with a header."""
    out = failures.select("url", "reason", "status_code",
                          F.date_format("failed_time", "yyyy-MM-dd HH:mm:ss").alias("failed_time"))
    write_csv(out, path)


def write_article_table(articles: DataFrame, path: str) -> bool:
    """Checked, cleaned append to the article table (duplicates kept).

    Partitioned by scrape date (date filters prune folders); inside a folder
    rows are sorted by site and URL, so parquet min/max statistics skip row
    groups for site or URL filters (the source table's secondary indexes).
    Returns False for an empty input (checked with a one-row probe).
    """
    rows = prepare_article_rows(articles)
    if rows.isEmpty():
        return False
    out = (rows.withColumn("created_at", F.localtimestamp())
           .withColumn("scraped_date", F.to_date("scraped_time")))
    # rebalance: AQE sizes the write tasks per date folder, splitting a big day
    # over several tasks and merging small ones, so every folder gets a few
    # right-sized files instead of one file per task and folder
    (out.hint("rebalance", "scraped_date").sortWithinPartitions("scraped_date", "site", "url")
     .write.mode("append").partitionBy("scraped_date").parquet(path))
    return True


def read_article_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in ARTICLE_TABLE.fields])


def create_table_if_missing(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """``CREATE TABLE IF NOT EXISTS`` for a path table: an empty table with the schema."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def table_ddl(name: str, schema: T.StructType, location: str | None = None,
              partitioned_by=()) -> str:
    """Spark SQL DDL text for a catalog table."""
    cols = ",\n  ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    ddl = f"CREATE TABLE IF NOT EXISTS {name} (\n  {cols}\n) USING parquet"
    if partitioned_by:
        ddl += f" PARTITIONED BY ({', '.join(partitioned_by)})"
    if location:
        ddl += f" LOCATION '{location}'"
    return ddl


def append_failed_rows(spark: SparkSession, failed: DataFrame, path: str) -> None:
    create_table_if_missing(spark, path, FAILED_FETCH)
    out = failed.select(*[F.col(f.name).cast(f.dataType) for f in FAILED_FETCH.fields])
    out.write.mode("append").parquet(path)


# ------------------------------------------------------------ search index

def index_required(articles: DataFrame) -> DataFrame:
    """Documents that have url, title and content (key present)."""
    return articles.filter(F.col("url").isNotNull() & F.col("title").isNotNull() & F.col("content").isNotNull())


def index_required_strict(articles: DataFrame) -> DataFrame:
    """As above, and none of the three may be empty."""
    return index_required(articles).filter(
        (F.length("url") > 0) & (F.length("title") > 0) & (F.length("content") > 0))


def index_actions(articles: DataFrame, index: str = "article_store") -> DataFrame:
    """Bulk-index rows: (url, action JSON, source JSON)."""
    doc = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in
                     ("title", "content", "description", "keywords", "url", "site", "website_category")],
                   F.col("site_id").cast("int").alias("site_id"),
                   F.date_format("scraped_time", "yyyy-MM-dd").alias("scraped_time"))
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("index")))
    return index_required(articles).select("url", action.alias("action"), F.to_json(doc).alias("source"))


def write_bulk_ndjson(actions: DataFrame, path: str) -> None:
    """Newline-delimited bulk body: an action line followed by its source line."""
    lines = actions.select(F.concat_ws("\n", "action", "source").alias("value"))
    lines.write.mode("append").text(path)


# --------------------------------------------------------------- messages

def result_messages(articles: DataFrame, topic: str = "Results") -> DataFrame:
    """Kafka rows for fetch results: url as key, the article as JSON value."""
    cols = [c for c in articles.columns]
    return articles.select(F.lit(topic).alias("topic"), F.col("url").alias("key"),
                           F.to_json(F.struct(*cols)).alias("value"))


def task_messages(links: DataFrame, link_col: str = "link", topic_col=None,
                  topic: str = "Tasks") -> DataFrame:
    """Task rows ``{"url": ...}``; links without a URL are rejected."""
    l = links.filter(F.col(link_col).isNotNull() & (F.col(link_col) != ""))
    t = F.lit(topic) if topic_col is None else topic_col
    return l.select(t.alias("topic"), F.to_json(F.struct(F.col(link_col).alias("url"))).alias("value"))


def write_messages(rows: DataFrame, path_or_servers: str, use_kafka: bool = False) -> None:
    """Publish (topic, key, value) rows: to Kafka when asked (acks=all), else JSON files."""
    if use_kafka:
        (rows.write.format("kafka").option("kafka.bootstrap.servers", path_or_servers)
         .option("kafka.acks", "all").save())
    else:
        rows.write.mode("append").partitionBy("topic").json(path_or_servers)


# ------------------------------------------------------ reports, snapshots

def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def save_failure_snapshot(tasks: DataFrame, path: str) -> None:
    """Pending and permanent tasks (``state`` column) with times as text."""
    out = tasks
    for c in ("first_failed_at", "last_failed_at", "next_retry_at"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    if "extra_data" not in out.columns:
        out = out.withColumn("extra_data", F.create_map().cast("map<string,string>"))
    out.write.mode("overwrite").json(path)


def jdbc_write(df: DataFrame, url: str, table: str, properties: dict | None = None,
               batch_size: int = 1000, mode: str = "append") -> None:
    """Batched insert into a SQL table (one connection per partition)."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_size)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.mode(mode).save()


def retention_prune(spark: SparkSession, path: str, date_col: str, days: int) -> DataFrame:
    """Drop the date partitions more than ``days`` days before the newest one.

    Only the partition values are read (one row per folder); expired folders
    are deleted and nothing that stays is rewritten.
    """
    dates = spark.read.parquet(path).select(date_col).distinct()
    newest = dates.select(F.max(date_col)).scalar()
    expired = dates.filter(F.col(date_col) < F.date_sub(newest, days))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in expired.select(F.col(date_col).cast("string").alias("v")).collect():
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{date_col}={r['v']}"), True)
    return spark.read.parquet(path)
