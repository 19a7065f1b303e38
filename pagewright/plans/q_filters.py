"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import articles as AR
from ..operators import failures as FL
from ..operators import stats as ST
from ..operators.joins import broadcast_bounded
from ..sources import fixtures as fx
from ..sources.readers import log_lines, parse_messages, render_fetch_log
from . import common as C
from . import oracle as O
from .registry import query

VALID_SQL = """CASE WHEN coalesce(s.url_pattern, '') = '' THEN true
  WHEN s.is_regex THEN regexp_matches(a.url, '^(?:' || s.url_pattern || ')')
  ELSE contains(a.url, s.url_pattern) END"""


@query("url_valid", f"""
SELECT a.doc_id, a.url, {VALID_SQL} AS is_valid FROM fx_article a LEFT JOIN fx_site s USING (site)""")
def url_valid(spark, sf):
    s = fx.fx_site(spark, sf).select("site", "url_pattern", "is_regex")
    a = fx.fx_article(spark, sf).join(broadcast_bounded(s), "site", "left")
    return a.select("doc_id", "url", U.url_valid("url", "url_pattern", "is_regex").alias("is_valid"))


@query("url_strip_query", "SELECT page_id, pos, link, split_part(link, '?', 1) AS stripped FROM fx_link")
def url_strip_query(spark, sf):
    return fx.fx_link(spark, sf).select("page_id", "pos", "link", U.url_strip_query("link").alias("stripped"))


@query("url_canonical_host", """
SELECT a.doc_id, CASE WHEN contains(a.url, a.site || '.example.com') AND NOT contains(a.url, 'star.' || a.site || '.example.com')
  THEN replace(a.url, 'www.' || a.site || '.example.com', a.site || '.example.com') ELSE a.url END AS canonical_url
FROM fx_article a""")
def url_canonical_host(spark, sf):
    # one host rule per site: the 'www.' mirror becomes the main host, 'star.' hosts are kept
    rules = fx.fx_site(spark, sf).select(
        "site", F.concat("site", F.lit(".example.com")).alias("contains"),
        F.concat(F.lit("star."), "site", F.lit(".example.com")).alias("excluded"),
        F.col("domain").alias("host_from"), F.concat("site", F.lit(".example.com")).alias("host_to"))
    a = fx.fx_article(spark, sf).join(broadcast_bounded(rules), "site", "left")
    return a.select("doc_id", U.url_canonical_host("url", "contains", "excluded", "host_from", "host_to")
                    .alias("canonical_url"))


@query("required_columns", "SELECT doc_id, site, url FROM fx_article")
def required_columns(spark, sf):
    return AR.required_columns(fx.fx_article(spark, sf)).select("doc_id", "site", "url")


@query("fill_text_nulls", "SELECT doc_id, title, coalesce(keywords, '') AS keywords FROM fx_article")
def fill_text_nulls(spark, sf):
    return AR.fill_text_nulls(fx.fx_article(spark, sf)).select("doc_id", "title", "keywords")


@query("truncate_content", """
SELECT doc_id, md5(left(content, 65535)) AS content_md5, CAST(length(left(content, 65535)) AS BIGINT) AS content_chars,
  length(content) > 65535 AS content_truncated FROM fx_article""")
def truncate_content(spark, sf):
    t = AR.truncate(fx.fx_article(spark, sf))
    return t.select("doc_id", F.md5("content").alias("content_md5"),
                    F.length("content").cast("long").alias("content_chars"), "content_truncated")


PUBLISH_PARSE_SQL = ("try_strptime(nullif(trim({x}), ''), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M'])")


@query("publish_time_nullify", f"""
SELECT doc_id, CAST(try_strptime(nullif(trim(x), ''), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M']) AS TIMESTAMP) AS publish_time
FROM (SELECT doc_id, {O.d_publish_extract('content')} AS x FROM fx_article) t""")
def publish_time_nullify(spark, sf):
    a = fx.fx_article(spark, sf)
    return a.select("doc_id", X.publish_time_nullify(X.publish_time_extract("content")).alias("publish_time"))



D_ARTICLE_TEXT = O.d_unescape("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', '', 'g')")
D_EXTRACTED = f"""SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN CAST(to_json([{{'content': {D_ARTICLE_TEXT}}}]) AS VARCHAR)
  WHEN 1 THEN CAST(to_json({{'content': {D_ARTICLE_TEXT}}}) AS VARCHAR)
  ELSE '[{{"content": ' || CAST(to_json({{'content': {D_ARTICLE_TEXT}}}) AS VARCHAR) END AS extracted FROM pages"""
D_CONTENT = """CASE WHEN NOT json_valid(extracted) THEN left(html, 10000)
  WHEN starts_with(trim(extracted), '[')
    THEN try(json_extract_string(extracted, '$[0].content'))
  ELSE try(json_extract_string(extracted, '$.content')) END"""

@query("raw_html_fallback", f"""
SELECT page_id, extracted IS NULL AS missing, NOT json_valid(extracted) AS used_fallback,
  md5({D_CONTENT}) AS content_md5, CAST(length({D_CONTENT}) AS BIGINT) AS content_chars FROM ({D_EXTRACTED}) e""")
def raw_html_fallback(spark, sf):
    e = fx_extracted(spark, sf)
    c = AR.extracted_content("extracted", "html")
    return e.select("page_id", F.col("extracted").isNull().alias("missing"),
                    (F.get_json_object(F.concat(F.lit('{"v":'), F.trim("extracted"), F.lit("}")), "$.v").isNull())
                    .alias("used_fallback"),
                    F.md5(c).alias("content_md5"), F.length(c).cast("long").alias("content_chars"))


def fx_extracted(spark, sf):
    """Extractor output per page: a JSON list, a JSON object or broken JSON."""
    from ..functions.html import article_text
    from ..sources.tables import read_table
    p = read_table(spark, sf, "pages")
    body = article_text("html")
    item = F.struct(body.alias("content"))
    ext = (F.when(F.col("page_id") % 3 == 0, F.to_json(F.array(item)))
           .when(F.col("page_id") % 3 == 1, F.to_json(item))
           .otherwise(F.concat(F.lit('[{"content": '), F.to_json(item))))
    return p.select("page_id", "html", ext.alias("extracted"))


@query("extracted_content_merge", f"""
SELECT page_id, {D_CONTENT} AS content FROM ({D_EXTRACTED}) e""")
def extracted_content_merge(spark, sf):
    e = fx_extracted(spark, sf)
    return e.select("page_id", AR.extracted_content("extracted", "html").alias("content"))


@query("metadata_only", """
SELECT a.doc_id, md5(CASE WHEN s.extract_only_metadata THEN '' ELSE a.content END) AS content_md5
FROM fx_article a LEFT JOIN fx_site s USING (site)""")
def metadata_only(spark, sf):
    s = fx.fx_site(spark, sf).select("site", "extract_only_metadata")
    a = AR.metadata_only(fx.fx_article(spark, sf).join(broadcast_bounded(s), "site", "left"))
    return a.select("doc_id", F.md5("content").alias("content_md5"))


@query("add_site_columns", """
SELECT a.doc_id, a.url, a.site, s.site_id, s.website_category FROM fx_article a LEFT JOIN fx_site s USING (site)""")
def add_site_columns(spark, sf):
    a = fx.fx_article(spark, sf).select("doc_id", "url", "site", F.array("url").alias("next_level_links"))
    return AR.add_site_columns(a, fx.fx_site(spark, sf)).select("doc_id", "url", "site", "site_id",
                                                                "website_category")


@query("sites_by_category", "SELECT site, site_id FROM fx_site WHERE website_category = 'news'")
def sites_by_category(spark, sf):
    from ..sources.site_config import sites_by_category as sbc
    return sbc(fx.fx_site(spark, sf), "news").select("site", "site_id")


@query("index_required_fields", """
SELECT doc_id FROM fx_article WHERE url IS NOT NULL AND title IS NOT NULL AND content IS NOT NULL""")
def index_required_fields(spark, sf):
    from ..sources.sinks import index_required
    return index_required(fx.fx_article(spark, sf)).select("doc_id")


@query("failed_retryable", "SELECT url_key, retry_count FROM fx_failed WHERE retry_count < 3")
def failed_retryable(spark, sf):
    return FL.failed_retryable(C.failed(spark, sf)).select("url_key", "retry_count")


@query("status_acceptable", """
SELECT event_id, coalesce(status_code >= 200 AND status_code < 300, false) AS acceptable FROM fx_fetch""")
def status_acceptable(spark, sf):
    from ..operators.health import status_acceptable as sa
    f = fx.fx_fetch(spark, sf)
    return f.select("event_id", sa("status_code").alias("acceptable"))


LOG_SQL = """SELECT ts AS log_time, CASE WHEN success THEN 'INFO' ELSE 'ERROR' END AS level,
  CASE WHEN success THEN 'Fetched ' || url || ' status ' || CAST(status_code AS VARCHAR)
       ELSE 'Failed to fetch ' || url || ': ' || coalesce(error_name, 'HTTP ' || CAST(status_code AS VARCHAR))
            || CASE WHEN depth = 2 THEN ' (retry scheduled)' ELSE '' END END AS message
FROM fx_fetch"""


@query("error_log_lines", f"""
SELECT log_time, level, message FROM ({LOG_SQL}) t
WHERE regexp_matches(level || ' ' || message, '(?i)error|exception|fatal|failed|crash')
  AND NOT contains(level || ' ' || message, 'retry')""")
def error_log_lines(spark, sf):
    from ..operators.health import error_log_lines as ell
    from ..session import scratch_path
    path = scratch_path(spark, "fetch-log")
    render_fetch_log(fx.fx_fetch(spark, sf)).write.text(path)
    return ell(log_lines(spark, path)).select("log_time", "level", "message")


@query("drop_blank_messages", """
SELECT event_id, CAST(json_extract(value, '$.k') AS INTEGER) AS k FROM fx_message WHERE trim(value, ' ') <> ''""")
def drop_blank_messages(spark, sf):
    m = parse_messages(fx.fx_message(spark, sf), "k int")
    return m.filter(F.col("message").isNotNull()).select("event_id", F.col("message.k").alias("k"))


@query("failure_record", "SELECT event_id, url, reason, status_code, failed_time FROM fx_failure")
def failure_record(spark, sf):
    return C.failures(spark, sf)


@query("reason_preview", """
SELECT url_key, CASE WHEN length(reason) < 100 THEN reason ELSE left(reason, 100) || '...' END AS reason FROM fx_failed""")
def reason_preview(spark, sf):
    return C.failed(spark, sf).select("url_key", X.reason_preview("reason").alias("reason"))


@query("recent_days", """
SELECT doc_id, scraped_time FROM fx_article
WHERE scraped_time >= (SELECT max(scraped_time) FROM fx_article) - INTERVAL 2 DAY""")
def recent_days(spark, sf):
    return ST.recent(fx.fx_article(spark, sf), "scraped_time", 2).select("doc_id", "scraped_time")
