"""User extension surface."""

import json

from pyspark.sql import functions as F

from ..functions import errors as E
from ..operators import failures as FL
from ..operators import rules as R
from ..operators.extract import extract_by_selector as _extract
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import common as C
from . import oracle as O
from .q_exprs import CLASSIFY_SQL
from .registry import query

# a user rule for the fixture's 'other' sites: drop the member banner, tidy blank lines
CUSTOM_SITE = "other"
CUSTOM_RULES = R.SiteRules(steps=[r"加入會員.*?閱讀無上限"], collapse=True)

with R.scoped_site(CUSTOM_SITE, CUSTOM_RULES):
    _CUSTOM_SQL = f"""
WITH b AS (SELECT doc_id, rule_site, {O.d_clean_content('rule_site', 'content')} AS base FROM fx_article)
SELECT doc_id, {O.d_site_level('rule_site', 'base')} AS content FROM b"""


@query("site_rule_registry", _CUSTOM_SQL)
def site_rule_registry(spark, sf):
    with R.scoped_site(CUSTOM_SITE, CUSTOM_RULES):
        content = R.site_content("rule_site", "content")
    return fx.fx_article(spark, sf).select("doc_id", content.alias("content"))


def _spec(base, headline, content):
    return json.dumps({"name": "Article", "baseSelector": base, "fields": [
        {"name": "headline", "selector": headline, "type": "text", "multiple": False},
        {"name": "content", "selector": content, "type": "text", "multiple": True}]})


# one spec for each site, as a table
SELECTOR_SPECS = [("site0", _spec("body", "article > h1", "article")),
                  ("site1", _spec("html", "body > article h1:first-child", "body article:nth-child(n+2), main.none")),
                  ("site2", _spec("*", "body article > h1:nth-child(2n+1)", "body > article"))]


def _strip(expr):
    return O.d_unescape(f"regexp_replace({expr}, '<[^>]*>', '', 'g')")


@query("extract_by_selector", f"""
SELECT page_id, 'site' || CAST(page_id % 3 AS VARCHAR) AS site,
  nullif({_strip("regexp_extract(html, '(?is)<article[^>]*>[[:space:]]*<h1[^>]*>(.*?)</h1>', 1)")}, '') AS headline,
  {_strip("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS content
FROM pages""")
def extract_by_selector(spark, sf):
    pages = read_table(spark, sf, "pages").withColumn(
        "site", F.concat(F.lit("site"), (F.col("page_id") % 3).cast("string")))
    return _extract(pages, spark.createDataFrame(SELECTOR_SPECS, "site string, spec string"), ["headline", "content"])


@query("on_permanent_failure", """
SELECT url, error_category, retry_count FROM fx_tasks WHERE state = 'permanent'""")
def on_permanent_failure(spark, sf):
    path = scratch_path(spark, "permanent")
    FL.for_each_permanent(C.tasks(spark, sf), lambda df: df.write.mode("append").parquet(path))
    return spark.read.parquet(path).select("url", "error_category", "retry_count")


# user overrides as stored JSON: fewer network retries, shorter client-error waits
OVERRIDES_JSON = json.dumps([{"error_category": "network_error", "max_retries": 2},
                             {"error_category": "client_error", "min_delay": 1.0, "max_delay": 2.0}])


@query("policy_overrides", f"""
SELECT f.event_id, f.error_category, coalesce(o.max_retries, p.max_retries, 3) AS max_retries,
  coalesce(o.min_delay, p.min_delay, 10.0) AS min_delay, coalesce(o.max_delay, p.max_delay, 30.0) AS max_delay,
  least((coalesce(o.min_delay, p.min_delay, 10.0) + coalesce(o.max_delay, p.max_delay, 30.0)) / 2.0 * 9.0, 500.0) AS second_delay
FROM (SELECT event_id, {CLASSIFY_SQL} AS error_category FROM fx_fetch WHERE NOT success) f
LEFT JOIN (VALUES {", ".join(f"('{c}', {m}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for c, m, lo, hi in E.POLICY)})
  p(error_category, max_retries, min_delay, max_delay) USING (error_category)
LEFT JOIN (VALUES ('network_error', 2, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('client_error', NULL, 1.0, 2.0))
  o(error_category, max_retries, min_delay, max_delay) USING (error_category)""")
def policy_overrides(spark, sf):
    raw = spark.createDataFrame([(OVERRIDES_JSON,)], "value string")
    ov = raw.select(F.explode(F.from_json("value", "array<struct<error_category string, max_retries int, "
                                                   "min_delay double, max_delay double>>")).alias("o")).select("o.*")
    policy = E.policy_table(spark, ov)
    f = fx.fx_fetch(spark, sf).filter(~F.col("success")).select(
        "event_id", E.classify_error("error_name", "status_code").alias("error_category"))
    slower = E.Backoff(factor=3.0, cap=500.0)
    return E.with_policy(f, policy).withColumn(
        "second_delay", E.retry_delay_seconds(F.lit(2), "min_delay", "max_delay", backoff=slower))


# ------------------------------------------------------------ flagship

from .flagship import new_articles_per_site_day  # noqa: E402
from .q_io import _CLEAN_SQL  # noqa: E402


@query("new_articles_per_site_day", _CLEAN_SQL + """
SELECT p.site, s.site_id, s.website_category, CAST(p.scraped_time AS DATE) AS day, count(*) AS n_articles,
  count(pt) AS n_with_publish_time, CAST(sum(length(full_text)) AS BIGINT) AS content_chars
FROM p LEFT JOIN fx_site s USING (site)
WHERE NOT EXISTS (SELECT 1 FROM fx_existing e WHERE e.url = p.url)
GROUP BY ALL""")
def flagship(spark, sf):
    return new_articles_per_site_day(spark, sf)
