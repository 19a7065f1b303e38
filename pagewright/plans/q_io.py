"""Sources and sinks.  Sink queries write to the shared scratch
folder and read the result back, so they check the round trip."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..operators import stats as ST
from ..sources import fixtures as fx
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources import topics as TP
from ..sources.schemas import FETCH_REPORT, FAILED_FETCH
from ..sources.site_config import list_sites
from ..sources.tables import read_table
from ..session import scratch_path
from ..streaming.streams import batch_folder_writer
from . import common as C
from . import oracle as O
from .q_aggs import REPORT_SQL
from .q_exprs import D_TITLE, _d_meta
from .registry import query


@query("src_pages", f"""
SELECT page_id, url, {D_TITLE} AS title, {_d_meta('description')} AS description, {_d_meta('keywords')} AS keywords,
  CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links,
  html IS NOT NULL AND length(html) > 0 AS success FROM pages""")
def src_pages(spark, sf):
    p = RD.read_pages(spark, f"{sf}/pages.parquet")
    m = H.page_metadata("html")
    return p.select("page_id", "url", m["title"].alias("title"), m["description"].alias("description"),
                    m["keywords"].alias("keywords"), F.size(H.hrefs("html")).cast("long").alias("n_links"),
                    (F.col("html").isNotNull() & (F.length("html") > 0)).alias("success"))


@query("src_site_config", """
SELECT site, coalesce(site_id, 0) AS site_id, coalesce(website_category, 'unknown') AS website_category,
  coalesce(domain_delay, 3.0) AS domain_delay FROM fx_site""")
def src_site_config(spark, sf):
    return list_sites(fx.fx_site(spark, sf))


ARTICLE_CSV = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType()),
                            T.StructField("content", T.StringType()), T.StructField("site", T.StringType()),
                            T.StructField("depth", T.IntegerType())])


@query("sink_article_csv", """
SELECT doc_id, site, CAST(doc_id % 2 + 1 AS INTEGER) AS depth, title, content FROM fx_article""")
def sink_article_csv(spark, sf):
    a = fx.fx_article(spark, sf).select("doc_id", "title", "content", "site",
                                        (F.col("doc_id") % 2 + 1).cast("int").alias("depth"))
    path = scratch_path(spark, "article-csv")
    SK.write_article_csv(a, path)
    return SK.read_csv(spark, path, ARTICLE_CSV).select("doc_id", "site", "depth", "title", "content")


FAILED_CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "reason", "status_code", "failed_time")])


@query("sink_failed_csv", """
SELECT url, reason, status_code, strftime(failed_time, '%Y-%m-%d %H:%M:%S') AS failed_time FROM fx_failure""")
def sink_failed_csv(spark, sf):
    f = C.failures(spark, sf)
    cut = F.lit(fx.UPSERT_CUTOFF).cast("timestamp_ntz")
    path = scratch_path(spark, "failed-csv")
    SK.write_failed_csv(f.filter(F.col("failed_time") < cut), path)   # two appends,
    SK.write_failed_csv(f.filter(F.col("failed_time") >= cut), path)  # one header per file
    return SK.read_csv(spark, path, FAILED_CSV)


_CLEAN_SQL = f"""WITH b AS (SELECT *, {O.d_clean_content('rule_site', 'content')} AS base FROM fx_article),
f AS (SELECT *, {O.d_site_level('rule_site', 'base')} AS full_text FROM b),
p AS (SELECT *, {O.d_site_publish('rule_site', 'base', 'full_text')} AS pt FROM f)"""


@query("sink_article_table", _CLEAN_SQL + """
SELECT site_id, website_category, scraped_time, site, coalesce(title, '') AS title, left(full_text, 65535) AS content,
  url, '' AS description, coalesce(keywords, '') AS keywords,
  CAST(try_strptime(nullif(trim(pt), ''), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M']) AS TIMESTAMP) AS publish_time FROM p""")
def sink_article_table(spark, sf):
    path = scratch_path(spark, "article-store")
    SK.write_article_table(C.cleaned_articles(spark, sf), path)
    return SK.read_article_table(spark, path).drop("created_at")


@query("sink_index_docs", """
SELECT url, '{"index":{"_index":"article_store"}}' AS action,
  CAST(to_json({'title': title, 'content': content, 'description': '', 'keywords': coalesce(keywords, ''), 'url': url,
    'site': site, 'website_category': website_category, 'site_id': site_id,
    'scraped_time': strftime(scraped_time, '%Y-%m-%d')}) AS VARCHAR) AS source
FROM fx_article WHERE url IS NOT NULL AND title IS NOT NULL AND content IS NOT NULL""")
def sink_index_docs(spark, sf):
    a = fx.fx_article(spark, sf).withColumn("description", F.lit(""))
    path = scratch_path(spark, "bulk")
    SK.write_bulk_ndjson(SK.index_actions(a), path)
    return RD.read_bulk_ndjson(spark, path)


@query("sink_index_doc_strict", """
SELECT url FROM fx_article WHERE length(url) > 0 AND length(title) > 0 AND length(content) > 0""")
def sink_index_doc_strict(spark, sf):
    return SK.index_required_strict(fx.fx_article(spark, sf)).select("url")


@query("sink_results_stream", f"""
SELECT 'Results' AS topic, url AS key, CAST(to_json({{'url': url, 'title': {D_TITLE},
  'next_level_links': regexp_extract_all(html, '<a href="([^"]*)"', 1)}}) AS VARCHAR) AS value FROM pages""")
def sink_results_stream(spark, sf):
    p = read_table(spark, sf, "pages")
    art = p.select("url", H.html_title("html").alias("title"), H.hrefs("html").alias("next_level_links"))
    path = scratch_path(spark, "results")
    SK.write_messages(SK.result_messages(art), path)
    return RD.read_messages(spark, path)


@query("sink_tasks_stream", """
SELECT 'Tasks_' || CAST(page_id % 3 AS VARCHAR) AS topic, CAST(to_json({'url': link}) AS VARCHAR) AS value FROM fx_link WHERE link IS NOT NULL AND link <> ''""")
def sink_tasks_stream(spark, sf):
    path = scratch_path(spark, "tasks")
    SK.write_messages(SK.task_messages(fx.fx_link(spark, sf), topic_col=F.concat(F.lit("Tasks_"), (
        F.col("page_id") % 3).cast("string"))), path)
    return RD.read_messages(spark, path).select("topic", "value")


@query("src_messages", """
SELECT event_id, CASE WHEN trim(value, ' ') <> '' THEN CAST(json_extract(value, '$.k') AS INTEGER) END AS k FROM fx_message""")
def src_messages(spark, sf):
    """The messages are published as a topic and consumed poll by poll, many polls in a micro-batch."""
    path = scratch_path(spark, "topic")
    m = fx.fx_message(spark, sf).withColumn("key", F.col("event_id").cast("string"))
    TP.publish_topic(m.select("key", "value", "ts", "event_id"), path, "events", ["ts", "event_id"])
    TP.consume(TP.topic_stream(spark, path, "events", group="readers", polls_per_batch=TP.BACKLOG_POLLS),
               f"{path}/checkpoint", batch_folder_writer(f"{path}/polled"))
    got = RD.parse_messages(spark.read.parquet(f"{path}/polled"), "k int")
    return got.select(F.col("key").cast("long").alias("event_id"), F.col("message.k").alias("k"))


@query("sink_run_report", f"""
SELECT site_name, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time,
  duration_seconds, total_urls, successful_urls, failed_urls, retry_urls, printf('%.2f%%', success_rate) AS success_rate,
  d.depth_stats, e.error_types
FROM ({REPORT_SQL}) r
LEFT JOIN (SELECT site, string_agg(depth || '=' || n, ';' ORDER BY CAST(depth AS VARCHAR)) AS depth_stats
           FROM (SELECT site, depth, count(*) AS n FROM fx_fetch WHERE success GROUP BY 1, 2) x GROUP BY site) d ON d.site = site_name
LEFT JOIN (SELECT site, string_agg(t || '=' || n, ';' ORDER BY t) AS error_types
           FROM (SELECT site, 'Error: ' || coalesce(error_name, 'Unknown error') || ', Status: '
                        || coalesce(CAST(status_code AS VARCHAR), 'None') AS t, count(*) AS n
                 FROM fx_fetch WHERE NOT success GROUP BY 1, 2) x GROUP BY site) e ON e.site = site_name""")
def sink_run_report(spark, sf):
    f = fx.fx_fetch(spark, sf)
    doc = ST.report_document(ST.run_report(f), ST.depth_counts(f), ST.error_type_counts(f))
    path = scratch_path(spark, "run-report")
    SK.write_report(doc, path)
    back = spark.read.schema(FETCH_REPORT).json(path)
    for c in ("depth_stats", "error_types"):
        entries = F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
        back = back.withColumn(c, F.when(F.size(c) > 0, F.array_join(entries, ";")))
    return back


@query("failure_snapshot_roundtrip", """
SELECT state, url, site_name, error_category, error_message, status_code, retry_count,
  date_trunc('second', first_failed_at) AS first_failed_at, date_trunc('second', last_failed_at) AS last_failed_at,
  CASE WHEN state = 'pending' THEN date_trunc('second', next_retry_at) END AS next_retry_at FROM fx_tasks""")
def failure_snapshot_roundtrip(spark, sf):
    path = scratch_path(spark, "failure-snapshot")
    SK.save_failure_snapshot(C.tasks(spark, sf), path)
    return RD.read_failure_snapshot(spark, path).drop("extra_data")


@query("ddl_tables", "SELECT url, reason, status_code, failed_time, retry_count FROM fx_failed")
def ddl_tables(spark, sf):
    path = scratch_path(spark, "failed-fetches")
    SK.append_failed_rows(spark, C.failed(spark, sf), path)
    return spark.read.schema(FAILED_FETCH).parquet(path).select("url", "reason", "status_code", "failed_time",
                                                                 "retry_count")


@query("src_log_lines", """
SELECT log_time, level, message FROM (
  SELECT ts AS log_time, CASE WHEN success THEN 'INFO' ELSE 'ERROR' END AS level,
    CASE WHEN success THEN 'Fetched ' || url || ' status ' || CAST(status_code AS VARCHAR)
         ELSE 'Failed to fetch ' || url || ': ' || coalesce(error_name, 'HTTP ' || CAST(status_code AS VARCHAR))
              || CASE WHEN depth = 2 THEN ' (retry scheduled)' ELSE '' END END AS message,
    event_id FROM fx_fetch) t
ORDER BY log_time DESC, level DESC, message DESC LIMIT 50""")
def src_log_lines(spark, sf):
    from ..operators.health import tail
    path = scratch_path(spark, "fetch-log")
    RD.render_fetch_log(fx.fx_fetch(spark, sf)).write.text(path)
    return tail(RD.log_lines(spark, path), 50).select("log_time", "level", "message")


@query("retention_prune", """
WITH d AS (SELECT CAST(scraped_time AS DATE) AS day FROM fx_article)
SELECT day, count(*) AS n FROM d WHERE day >= (SELECT max(day) FROM d) - INTERVAL 7 DAY GROUP BY day""")
def retention_prune(spark, sf):
    src = scratch_path(spark, "daily")
    fx.fx_article(spark, sf).select("doc_id", F.to_date("scraped_time").alias("day")) \
        .write.partitionBy("day").parquet(src)
    kept = SK.retention_prune(spark, src, "day", 7)
    return kept.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
