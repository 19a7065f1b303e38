"""Joins."""

from pyspark.sql import functions as F

from ..functions import errors as E
from ..operators import articles as AR
from ..operators import failures as FL
from ..operators import links as LK
from ..operators import rates as RT
from ..operators.joins import broadcast_bounded
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.fixtures import UPSERT_CUTOFF
from ..sources.tables import read_table
from ..streaming.streams import failed_delete, failed_table
from . import common as C
from .q_exprs import CLASSIFY_SQL, POLICY_SQL
from .q_filters import VALID_SQL
from .registry import query

NEW_LINKS_SQL = f"""SELECT a.site, a.url FROM fx_article a LEFT JOIN fx_site s USING (site)
WHERE {VALID_SQL} AND NOT EXISTS (SELECT 1 FROM fx_existing e WHERE e.url = a.url)"""


def new_links(spark, sf):
    a = fx.fx_article(spark, sf).select("site", "url")
    v = LK.valid_links(a, fx.fx_site(spark, sf))
    return LK.new_links_anti(v, fx.fx_existing(spark, sf))


@query("new_links_anti", NEW_LINKS_SQL)
def new_links_anti(spark, sf):
    return new_links(spark, sf)


@query("frontier_anti", """
SELECT DISTINCT split_part(link, '?', 1) AS link FROM fx_link l
WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = split_part(l.link, '?', 1))""")
def frontier_anti(spark, sf):
    nxt = LK.strip_queries(fx.fx_link(spark, sf), "link", "next").select(F.col("next").alias("link"))
    return LK.frontier_anti(nxt, read_table(spark, sf, "pages").select("url"))


@query("enrich_site", """
SELECT a.doc_id, a.site, s.site_id, s.website_category, s.domain_delay FROM fx_article a LEFT JOIN fx_site s USING (site)""")
def enrich_site(spark, sf):
    a = fx.fx_article(spark, sf).select("doc_id", "site")
    return AR.enrich_site(a, fx.fx_site(spark, sf))


@query("site_by_id", """
SELECT a.doc_id, a.site_id, m.site_name FROM fx_article a
LEFT JOIN (SELECT site_id, arg_max(site, ord) AS site_name FROM fx_site GROUP BY site_id) m USING (site_id)""")
def site_by_id(spark, sf):
    m = AR.site_by_id(fx.fx_site(spark, sf))
    return fx.fx_article(spark, sf).select("doc_id", "site_id").join(broadcast_bounded(m), "site_id", "left")


def _upsert_sql(where):
    return f"""SELECT left(url, 255) AS k, arg_min(url, (failed_time, event_id)) AS url,
  arg_max(reason, (failed_time, event_id)) AS reason, arg_max(status_code, (failed_time, event_id)) AS status_code,
  max(failed_time) AS failed_time, count(*) AS n, min(failed_time) AS created
FROM fx_failure WHERE {where} GROUP BY left(url, 255)"""


@query("failed_upsert", f"""
WITH s AS ({_upsert_sql(f"failed_time < TIMESTAMP '{UPSERT_CUTOFF}'")}),
b AS ({_upsert_sql(f"failed_time >= TIMESTAMP '{UPSERT_CUTOFF}'")})
SELECT coalesce(s.k, b.k) AS url_key,
  CASE WHEN s.k IS NULL THEN b.url ELSE s.url END AS url,
  CASE WHEN b.k IS NOT NULL THEN b.reason ELSE s.reason END AS reason,
  CASE WHEN b.k IS NOT NULL THEN b.status_code ELSE s.status_code END AS status_code,
  CASE WHEN b.k IS NOT NULL THEN b.failed_time ELSE s.failed_time END AS failed_time,
  CAST(CASE WHEN s.k IS NULL THEN b.n - 1 WHEN b.k IS NOT NULL THEN s.n - 1 + b.n ELSE s.n - 1 END AS INTEGER) AS retry_count,
  CASE WHEN s.k IS NULL THEN b.created ELSE s.created END AS created_at
FROM s FULL JOIN b ON s.k = b.k""")
def failed_upsert(spark, sf):
    f = C.failures(spark, sf)
    cut = F.lit(UPSERT_CUTOFF).cast("timestamp_ntz")
    snapshot = FL.failed_upsert(None, f.filter(F.col("failed_time") < cut))
    return FL.failed_upsert(snapshot, f.filter(F.col("failed_time") >= cut))


@query("failed_remove", """
SELECT url_key, url FROM fx_failed f WHERE NOT EXISTS (SELECT 1 FROM fx_fetch x WHERE x.success AND x.url = f.url)""")
def failed_remove(spark, sf):
    """The stored table loses the URLs that have been fetched since."""
    table = failed_table(spark, scratch_path(spark, "failed-table"))
    table.commit(C.failed(spark, sf))
    failed_delete(table, fx.fx_fetch(spark, sf).filter("success").select("url"))
    return table.read().select("url_key", "url")


@query("failed_for_site", """
SELECT site, url_key, failed_time, rank FROM (
  SELECT s.site, f.url_key, f.failed_time,
    row_number() OVER (PARTITION BY s.site ORDER BY f.failed_time DESC, f.url_key) AS rank
  FROM (SELECT * FROM fx_failed WHERE retry_count < 3) f JOIN (SELECT DISTINCT site FROM fx_site) s
    ON lower(f.url) LIKE '%' || lower(s.site) || '%') t
WHERE rank <= 10""")
def failed_for_site(spark, sf):
    r = FL.failed_for_site(C.failed(spark, sf), fx.fx_site(spark, sf))
    return r.select("site", "url_key", "failed_time", F.col("rank").cast("long"))


@query("domain_delay_lookup", """
SELECT d.domain, coalesce(s.domain_delay, 3.0) AS domain_delay FROM (SELECT DISTINCT domain FROM fx_fetch) d
LEFT JOIN (SELECT regexp_extract(start_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain,
  arg_max(domain_delay, ord) AS domain_delay FROM fx_site WHERE domain_delay IS NOT NULL GROUP BY 1) s USING (domain)""")
def domain_delay_lookup(spark, sf):
    d = fx.fx_fetch(spark, sf).select("domain").distinct()
    return RT.domain_delay_lookup(d, C.delays(spark, sf))


@query("retry_policy_join", f"""
SELECT f.event_id, f.error_category, coalesce(p.max_retries, 3) AS max_retries,
  coalesce(p.min_delay, 10.0) AS min_delay, coalesce(p.max_delay, 30.0) AS max_delay
FROM (SELECT event_id, {CLASSIFY_SQL} AS error_category FROM fx_fetch WHERE NOT success) f
LEFT JOIN {POLICY_SQL} USING (error_category)""")
def retry_policy_join(spark, sf):
    f = fx.fx_fetch(spark, sf).filter(~F.col("success")).select(
        "event_id", E.classify_error("error_name", "status_code").alias("error_category"))
    return E.with_policy(f, E.policy_table(spark))


@query("retry_success_semi", """
SELECT url_key, url FROM fx_failed f
WHERE EXISTS (SELECT 1 FROM fx_fetch x WHERE x.success AND x.url = f.url AND x.ts > f.failed_time)""")
def retry_success_semi(spark, sf):
    return FL.retry_success_semi(C.failed(spark, sf), fx.fx_fetch(spark, sf)).select("url_key", "url")
