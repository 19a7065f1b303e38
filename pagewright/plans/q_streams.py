"""Streaming operators.  Each query runs its stream over the
driver table as a file source with ``availableNow`` into a scratch sink and
reads the sink back; the oracle is the equivalent batch SQL."""

from pyspark.sql import functions as F

from ..functions import errors as E
from ..operators import failures as FL
from ..operators import rates as RT
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.tables import read_table
from ..streaming import streams as S
from . import common as C
from . import q_windows  # noqa: F401  (registers the fold fixture views used below)
from .q_io import _CLEAN_SQL
from .registry import query


def _paths(spark, name):
    return scratch_path(spark, name + "-out"), scratch_path(spark, name + "-ckpt")


@query("stream_parse_messages", """
SELECT event_id, CAST(json_extract(value, '$.k') AS INTEGER) AS k FROM fx_message WHERE trim(value, ' ') <> ''""")
def stream_parse_messages(spark, sf):
    out, ck = _paths(spark, "messages")
    m = fx.message_rows(S.table_stream(spark, sf, "events"))
    p = S.parse_message_stream(m, "k int").select("event_id", F.col("message.k").alias("k"))
    S.run_available_now(p, ck, S.batch_folder_writer(out))
    return spark.read.parquet(out).drop("batch")


@query("stream_article_ingest", _CLEAN_SQL + """
SELECT doc_id, url, site, pt AS publish_time, md5(full_text) AS content_md5 FROM p""")
def stream_article_ingest(spark, sf):
    out, ck = _paths(spark, "articles")
    S.article_ingest(fx.article_rows(S.table_stream(spark, sf, "documents")), out, ck, site_col="rule_site")
    return spark.read.parquet(out).select("doc_id", "url", "site", "publish_time", F.md5("content").alias("content_md5"))


@query("stream_new_links", """
SELECT DISTINCT link FROM fx_link l WHERE link IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = l.link)""")
def stream_new_links(spark, sf):
    out, ck = _paths(spark, "new-links")
    links = fx.link_rows(S.table_stream(spark, sf, "pages")).select("link").filter(F.col("link").isNotNull())
    S.new_links_stream(links, read_table(spark, sf, "pages").select("url"), out, ck)
    return spark.read.parquet(out).drop("batch")


@query("stream_failed_upsert", """
SELECT url_key, url, reason, status_code, failed_time, retry_count, created_at FROM fx_failed""")
def stream_failed_upsert(spark, sf):
    out, ck = _paths(spark, "failed-table")
    failures = FL.failure_record(fx.fetch_rows(S.table_stream(spark, sf, "events")))
    S.failed_upsert_stream(failures, out, ck)
    return S.failed_table(spark, out).read()


@query("stream_request_rate", """
WITH w AS (SELECT domain, CAST(to_timestamp((floor(epoch_us(ts) / 10000000) - k) * 10) AS TIMESTAMP) AS window_start
  FROM fx_fetch, range(6) r(k))
SELECT window_start, window_start + INTERVAL 60 SECOND AS window_end, domain, count(*) AS n,
  count(*) > 10 AS over_limit FROM w GROUP BY ALL""")
def stream_request_rate(spark, sf):
    out, ck = _paths(spark, "request-rate")
    f = fx.fetch_rows(S.table_stream(spark, sf, "events"))
    S.additive_counts(f, "ts", ["domain"], "60 seconds", "10 seconds", out, ck)
    n = S.summed_counts(spark, out, ["domain"])
    return n.withColumn("over_limit", F.col("n") > RT.GLOBAL_RATE_LIMIT)


@query("stream_counts_by_day", """
SELECT CAST(date_trunc('day', scraped_time) AS TIMESTAMP) AS window_start,
  CAST(date_trunc('day', scraped_time) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, site, count(*) AS n
FROM fx_article GROUP BY ALL""")
def stream_counts_by_day(spark, sf):
    out, ck = _paths(spark, "counts-by-day")
    a = fx.article_rows(S.table_stream(spark, sf, "documents")).select("site", "scraped_time")
    S.additive_counts(a, "scraped_time", ["site"], "1 day", None, out, ck)
    return S.summed_counts(spark, out, ["site"])


@query("stream_domain_state", "SELECT *, CAST(0 AS BIGINT) AS late FROM fx_throttle_final")
def stream_domain_state(spark, sf):
    out, ck = _paths(spark, "domain-state")
    f = fx.fetch_rows(S.table_stream(spark, sf, "events"))
    S.domain_state_stream(f, C.delays(spark, sf), out, ck)
    return S.domain_state(spark, out)


@query("stream_failure_state", """
SELECT url, state, site_name, error_category, error_message, status_code, retry_count, first_failed_at,
  last_failed_at, next_retry_at, state = 'pending' AND next_retry_at <= (SELECT max(ts) FROM fx_fetch) AS due,
  CAST(0 AS BIGINT) AS late FROM fx_tasks""")
def stream_failure_state(spark, sf):
    out, ck = _paths(spark, "failure-state")
    f = fx.fetch_rows(S.table_stream(spark, sf, "events"))
    S.failure_state_stream(f, E.policy_table(spark), out, ck)
    return S.current_tasks(spark, out)


@query("stream_content_change", """
SELECT page_key, seq, h AS content_hash FROM (
  SELECT page_key, seq, md5(element_text) AS h, lag(md5(element_text)) OVER (PARTITION BY page_key ORDER BY seq) AS prev
  FROM fx_snapshot) t WHERE prev IS NULL OR h <> prev""")
def stream_content_change(spark, sf):
    out, ck = _paths(spark, "content-change")
    snaps = fx.snapshot_rows(S.table_stream(spark, sf, "conversations"))
    S.content_change_stream(snaps, "page_key", "seq", "element_text", out, ck)
    return S.content_changes(spark, out)
