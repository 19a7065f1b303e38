"""Scalar expressions."""

from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..operators import rules as R
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import oracle as O
from .registry import query

@query("publish_time_extract", f"""
SELECT doc_id, {O.d_publish_extract('content')} AS publish_time FROM fx_article""")
def publish_time_extract(spark, sf):
    return fx.fx_article(spark, sf).select("doc_id", X.publish_time_extract("content").alias("publish_time"))


@query("clean_common", f"SELECT doc_id, {O.d_clean_common('content')} AS content FROM fx_article")
def clean_common(spark, sf):
    return R.stage_common(fx.fx_article(spark, sf), "content", "cleaned").select(
        "doc_id", F.col("cleaned").alias("content"))


@query("clean_site_base", f"""
SELECT doc_id, {O.d_clean_content('rule_site', 'content')} AS content FROM fx_article""")
def clean_site_base(spark, sf):
    return R.stage_base(fx.fx_article(spark, sf), "rule_site", "content", "cleaned").select(
        "doc_id", F.col("cleaned").alias("content"))


@query("clean_site_rules", f"""
WITH b AS (SELECT doc_id, rule_site, {O.d_clean_content('rule_site', 'content')} AS base FROM fx_article)
SELECT doc_id, {O.d_site_level('rule_site', 'base')} AS content FROM b""")
def clean_site_rules(spark, sf):
    d = R.stage_clean(fx.fx_article(spark, sf), "rule_site", "content", publish_out=None)
    return d.select("doc_id", F.col("_full").alias("content"))


@query("collapse_blank_lines", f"""
SELECT doc_id, {O.d_strip(O.d_collapse('content'))} AS content FROM fx_article""")
def collapse_blank_lines(spark, sf):
    return fx.fx_article(spark, sf).select("doc_id", X.collapse_and_strip("content").alias("content"))


@query("publish_time_site", f"""
WITH b AS (SELECT doc_id, rule_site, {O.d_clean_content('rule_site', 'content')} AS base FROM fx_article),
f AS (SELECT doc_id, rule_site, base, {O.d_site_level('rule_site', 'base')} AS full_text FROM b)
SELECT doc_id, {O.d_site_publish('rule_site', 'base', 'full_text')} AS publish_time FROM f""")
def publish_time_site(spark, sf):
    from ..operators.articles import clean_articles
    return clean_articles(fx.fx_article(spark, sf), "rule_site").select("doc_id", "publish_time")


# the fixture URLs put the category (the language) in the first path segment
FIXTURE_CATEGORY_PATTERN = r"^https://www[.]src[0-9]+[.]example[.]com/([^/]+)/"


@query("url_category", f"""
SELECT doc_id, nullif(regexp_extract(url, '{FIXTURE_CATEGORY_PATTERN}', 1), '') AS category FROM fx_article""")
def url_category(spark, sf):
    a = fx.fx_article(spark, sf).withColumn("pattern", F.lit(FIXTURE_CATEGORY_PATTERN))
    return a.select("doc_id", U.url_category("url", F.col("pattern")).alias("category"))


@query("url_ids", r"""
SELECT doc_id, nullif(regexp_extract(url, '/([0-9]+)$', 1), '') AS news_id,
  nullif(regexp_extract(url, 'NewsID=([0-9]+)', 1), '') AS news_id_param,
  nullif(regexp_extract(url, 'PageGroupID=([0-9]+)', 1), '') AS category_id
FROM fx_article""")
def url_ids(spark, sf):
    return fx.fx_article(spark, sf).select(
        "doc_id", U.url_news_id("url").alias("news_id"), U.url_news_id_param("url").alias("news_id_param"),
        U.url_category_id("url").alias("category_id"))


@query("url_domain", """
SELECT page_id, pos, regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain FROM fx_link""")
def url_domain(spark, sf):
    return fx.fx_link(spark, sf).select("page_id", "pos", U.url_domain("link").alias("domain"))


_STATUS_SQL = """CASE WHEN {s} = 429 THEN 'rate_limit' WHEN {s} = 403 THEN 'permission_error'
  WHEN {s} >= 400 AND {s} < 500 THEN 'client_error' WHEN {s} >= 500 AND {s} < 600 THEN 'server_error' END"""


def _classify_sql(name, status):
    n = f"lower(coalesce({name}, ''))"
    net = " OR ".join(f"contains({n}, '{w}')" for w in E.NETWORK_WORDS)
    par = " OR ".join(f"contains({n}, '{w}')" for w in E.PARSING_WORDS)
    return (f"coalesce({_STATUS_SQL.format(s=status)}, CASE WHEN {net} THEN 'network_error' "
            f"WHEN {par} THEN 'parsing_error' ELSE 'unknown_error' END)")


CLASSIFY_SQL = _classify_sql("error_name", "status_code")


@query("classify_error", f"SELECT event_id, {CLASSIFY_SQL} AS error_category FROM fx_fetch WHERE NOT success")
def classify_error(spark, sf):
    return (fx.fx_fetch(spark, sf).filter(~F.col("success"))
            .select("event_id", E.classify_error("error_name", "status_code").alias("error_category")))


@query("classify_error_text", f"""
SELECT event_id, coalesce({_STATUS_SQL.format(s='status_code')}, 'unknown_error') AS error_category
FROM fx_fetch WHERE NOT success""")
def classify_error_text(spark, sf):
    return (fx.fx_fetch(spark, sf).filter(~F.col("success"))
            .select("event_id", E.classify_error_text("status_code").alias("error_category")))


POLICY_SQL = "(VALUES " + ", ".join(
    f"('{c}', {m}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for c, m, lo, hi in E.POLICY) + \
    ") AS p(error_category, max_retries, min_delay, max_delay)"

_FAILED_CAT = "coalesce(" + _STATUS_SQL.format(s="TRY_CAST(status_code AS INTEGER)") + ", 'unknown_error')"


def _failed_with_policy(spark, sf):
    from ..operators.failures import failed_upsert, failure_record
    failed = failed_upsert(None, failure_record(fx.fx_fetch(spark, sf)))
    f = failed.withColumn("error_category", E.classify_error_text(F.expr("try_cast(status_code AS INT)")))
    return E.with_policy(f, E.policy_table(spark))


@query("should_retry", f"""
SELECT f.url_key, f.retry_count < coalesce(p.max_retries, 3) AS should_retry
FROM (SELECT *, {_FAILED_CAT} AS error_category FROM fx_failed) f LEFT JOIN {POLICY_SQL} USING (error_category)""")
def should_retry(spark, sf):
    f = _failed_with_policy(spark, sf)
    return f.select("url_key", E.should_retry("retry_count", "max_retries").alias("should_retry"))


@query("next_retry_at", f"""
SELECT f.url_key, f.failed_time + to_microseconds(CAST(round(least(
    (coalesce(p.min_delay, 10.0) + coalesce(p.max_delay, 30.0)) / 2.0 * pow(2.0, f.retry_count), 3600.0) * 1000000) AS BIGINT))
  AS next_retry_at
FROM (SELECT *, {_FAILED_CAT} AS error_category FROM fx_failed) f LEFT JOIN {POLICY_SQL} USING (error_category)""")
def next_retry_at(spark, sf):
    f = _failed_with_policy(spark, sf)
    return f.select("url_key", E.next_retry_at("failed_time", "retry_count", "min_delay", "max_delay")
                    .alias("next_retry_at"))


@query("linear_retry_delay", """
SELECT event_id, CAST(attempt - 1 AS INTEGER) AS attempt, CAST(6.5 * attempt AS DOUBLE) AS retry_delay
FROM (SELECT event_id, success, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS attempt FROM fx_fetch) t
WHERE attempt <= 3 AND NOT success""")
def linear_retry_delay(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("url").orderBy("ts", "event_id")
    f = fx.fx_fetch(spark, sf).withColumn("rn", F.row_number().over(w))
    f = f.filter(F.col("rn") <= E.FETCH_MAX_RETRIES).withColumn("attempt", F.col("rn") - 1).filter(~F.col("success"))
    return f.select("event_id", F.col("attempt").cast("int"), E.linear_retry_delay("attempt").alias("retry_delay"))


D_TITLE = O.d_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


def _d_meta(name):
    return O.d_unescape(f"""regexp_extract(html, '(?is)<meta\\s+name="{name}"\\s+content="([^"]*)"', 1)""")


@query("page_metadata", f"""
SELECT page_id, {D_TITLE} AS title, {_d_meta('description')} AS description, {_d_meta('keywords')} AS keywords
FROM pages""")
def page_metadata(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "html", H.meta_tags("html").alias("tags"))
    m = H.page_metadata("html", "tags")
    return p.select("page_id", m["title"].alias("title"), m["description"].alias("description"),
                    m["keywords"].alias("keywords"))


@query("page_links", """
SELECT page_id, pos, link FROM (
  SELECT page_id, pos, href, url,
    CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
         WHEN starts_with(href, '//') THEN concat(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), ':', href)
         WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), '://',
              regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), href)
         ELSE concat(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), '://',
              regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1),
              CASE WHEN regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '^(.*/)', 1) = ''
                   THEN '/' ELSE regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '^(.*/)', 1) END,
              href) END AS link
  FROM (SELECT p.page_id, p.url, l.pos, l.href FROM pages p JOIN fx_link l USING (page_id)) x) y
WHERE lower(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))
    = lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))""")
def page_links(spark, sf):
    from ..operators.links import page_links as pl
    return pl(read_table(spark, sf, "pages")).select("page_id", "pos", "link")


@query("content_hash", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.content_hash("text").alias("content_hash"))


@query("extra_data_merge", """
WITH kv AS (
  SELECT url, ts, event_id, 'status' AS name, CAST(status_code AS VARCHAR) AS value FROM fx_fetch WHERE NOT success
  UNION ALL SELECT url, ts, event_id, 'error', error_name FROM fx_fetch WHERE NOT success
  UNION ALL SELECT url, ts, event_id, 'depth', CAST(depth AS VARCHAR) FROM fx_fetch WHERE NOT success)
SELECT url, name, arg_max({'v': value}, (ts, event_id)).v AS value FROM kv GROUP BY url, name""")
def extra_data_merge(spark, sf):
    from ..operators.failures import extra_data_merge as merge
    f = fx.fx_fetch(spark, sf).filter(~F.col("success"))
    upd = f.select("url", "ts", "event_id", F.create_map(
        F.lit("status"), F.col("status_code").cast("string"), F.lit("error"), F.col("error_name"),
        F.lit("depth"), F.col("depth").cast("string")).alias("extra_data"))
    return merge(upd)
