"""Aggregations, top-k and set operations."""

from ..operators import failures as FL
from ..operators import links as LK
from ..operators import stats as ST
from ..sources import fixtures as fx
from ..sources.site_config import sites_grouped as _sites_grouped
from ..sources.tables import read_table
from . import common as C
from .registry import query


@query("articles_total", "SELECT count(*) AS total FROM fx_article")
def articles_total(spark, sf):
    return ST.articles_total(fx.fx_article(spark, sf))


@query("articles_by_site", "SELECT site, count(*) AS n FROM fx_article GROUP BY site")
def articles_by_site(spark, sf):
    return ST.count_by(fx.fx_article(spark, sf), "site")


@query("articles_by_category", "SELECT website_category, count(*) AS n FROM fx_article GROUP BY 1")
def articles_by_category(spark, sf):
    return ST.count_by(fx.fx_article(spark, sf), "website_category")


BY_DATE_SQL = """SELECT CAST(scraped_time AS DATE) AS day, count(*) AS n FROM fx_article
WHERE scraped_time >= (SELECT max(scraped_time) FROM fx_article) - INTERVAL 30 DAY
GROUP BY 1 ORDER BY 1 DESC"""


@query("articles_by_date", BY_DATE_SQL + " LIMIT 10")
def articles_by_date(spark, sf):
    return ST.articles_by_date(fx.fx_article(spark, sf))


@query("failed_total", "SELECT count(*) AS total FROM fx_failed")
def failed_total(spark, sf):
    return ST.articles_total(C.failed(spark, sf))


@query("failed_by_status", """
SELECT status_code, count(*) AS n FROM fx_failed GROUP BY 1 ORDER BY n DESC, status_code LIMIT 10""")
def failed_by_status(spark, sf):
    return ST.failed_by_status(C.failed(spark, sf))


@query("site_stats_all", f"""
SELECT 'total_articles' AS stat, CAST(NULL AS VARCHAR) AS key, count(*) AS value FROM fx_article
UNION ALL SELECT 'by_site', site, count(*) FROM fx_article GROUP BY site
UNION ALL SELECT 'by_category', website_category, count(*) FROM fx_article GROUP BY website_category
UNION ALL SELECT 'by_date', CAST(day AS VARCHAR), n FROM ({BY_DATE_SQL}) d
UNION ALL SELECT 'total_failed', NULL, count(*) FROM fx_failed
UNION ALL SELECT * FROM (SELECT 'failed_by_status', status_code, count(*) FROM fx_failed GROUP BY 2
                         ORDER BY 3 DESC, 2 LIMIT 10) f
UNION ALL SELECT * FROM (SELECT 'recent_failures', url_key, CAST(epoch_us(failed_time) // 1000000 AS BIGINT) FROM fx_failed
                         ORDER BY fx_failed.failed_time DESC, url_key LIMIT 10) g""")
def site_stats_all(spark, sf):
    return ST.site_stats_all(fx.fx_article(spark, sf), C.failed(spark, sf))


REPORT_SQL = """SELECT site AS site_name, min(ts) AS start_time, max(ts) AS end_time,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_seconds,
  count(*) AS total_urls, count(*) FILTER (WHERE success) AS successful_urls,
  count(*) FILTER (WHERE NOT success) AS failed_urls, count(*) - count(DISTINCT url) AS retry_urls,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE success) AS DOUBLE) * 100.0 / count(*) ELSE 0.0 END AS success_rate
FROM fx_fetch GROUP BY site"""


@query("run_report", REPORT_SQL)
def run_report(spark, sf):
    return ST.run_report(fx.fx_fetch(spark, sf))


@query("success_rate_pct", f"""
SELECT site_name, printf('%.2f%%', success_rate) AS success_rate FROM ({REPORT_SQL}) r""")
def success_rate_pct(spark, sf):
    r = ST.run_report(fx.fx_fetch(spark, sf))
    return r.select("site_name", ST.percent_column("success_rate").alias("success_rate"))


@query("depth_counts", "SELECT site, depth, count(*) AS n FROM fx_fetch WHERE success GROUP BY 1, 2")
def depth_counts(spark, sf):
    return ST.depth_counts(fx.fx_fetch(spark, sf))


@query("error_type_counts", """
SELECT site, 'Error: ' || coalesce(error_name, 'Unknown error') || ', Status: ' || coalesce(CAST(status_code AS VARCHAR), 'None')
  AS error_type, count(*) AS n FROM fx_fetch WHERE NOT success GROUP BY 1, 2""")
def error_type_counts(spark, sf):
    return ST.error_type_counts(fx.fx_fetch(spark, sf))


@query("batch_results", """
SELECT count(*) FILTER (WHERE ok) AS n_succeeded, count(*) AS n_sites
FROM (SELECT site, bool_or(success) AS ok FROM fx_fetch GROUP BY site) t""")
def batch_results(spark, sf):
    return ST.batch_results(fx.fx_fetch(spark, sf))


@query("sites_grouped", """
SELECT website_category, CAST(row_number() OVER (PARTITION BY website_category ORDER BY site) - 1 AS INTEGER) AS pos, site
FROM fx_site""")
def sites_grouped(spark, sf):
    return _sites_grouped(fx.fx_site(spark, sf))


@query("links_distinct", "SELECT DISTINCT link FROM fx_link")
def links_distinct(spark, sf):
    return LK.links_distinct(fx.fx_link(spark, sf))


# ------------------------------------------------------------ 2.6

@query("failed_queue_head", """
SELECT url_key, url, failed_time, retry_count FROM fx_failed WHERE retry_count < 3
ORDER BY failed_time DESC, url_key LIMIT 10""")
def failed_queue_head(spark, sf):
    return FL.failed_queue_head(C.failed(spark, sf)).select("url_key", "url", "failed_time", "retry_count")


@query("recent_failures", """
SELECT url, CASE WHEN length(reason) < 100 THEN reason ELSE left(reason, 100) || '...' END AS reason, status_code,
  strftime(failed_time, '%Y-%m-%d %H:%M:%S') AS failed_time, retry_count
FROM fx_failed ORDER BY fx_failed.failed_time DESC, url_key LIMIT 10""")
def recent_failures(spark, sf):
    return FL.recent_failures(C.failed(spark, sf))


@query("links_union", "SELECT link FROM fx_link UNION SELECT url FROM pages")
def links_union(spark, sf):
    return LK.links_union(fx.fx_link(spark, sf).select("link"), read_table(spark, sf, "pages").select("url"))


@query("links_except", "SELECT link FROM fx_link EXCEPT SELECT url FROM pages")
def links_except(spark, sf):
    return LK.links_except(fx.fx_link(spark, sf), read_table(spark, sf, "pages").select("url"))
