"""Fixture views derived from the driver tables (FIXTURES.md section 2).

Each builder reads the given tables, so the work grows with them.  The same
views are written as DuckDB SQL in ``pagewright.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# fixed split point between the stored failed-URL snapshot and a new batch
UPSERT_CUTOFF = "2024-01-15 00:00:00"


def fx_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 sites: NULL delays, three pattern modes, one duplicated site_id."""
    t = (read_table(spark, sf_dir, "documents").select(F.col("source").alias("site")).distinct()
         .withColumn("n", F.expr("CAST(substr(site, 4) AS INT)")))
    n = F.col("n")
    return t.select(
        "site",
        F.when(n == 19, F.lit(18)).otherwise(n).alias("site_id"),
        n.alias("ord"),
        F.expr("CASE n % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'forum' WHEN 2 THEN 'blog' "
               "ELSE 'finance_news' END").alias("website_category"),
        F.concat(F.lit("https://www."), "site", F.lit(".example.com/")).alias("start_url"),
        F.concat(F.lit("www."), "site", F.lit(".example.com")).alias("domain"),
        F.expr("CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN '/en/' "
               "ELSE '^https://www[.]src[0-9]+[.]example[.]com/[a-z]+/[0-9]+$' END").alias("url_pattern"),
        (n % 3 == 2).alias("is_regex"),
        F.expr("CAST(CASE WHEN n % 5 = 0 THEN NULL ELSE 1.5 + n % 4 END AS DOUBLE)").alias("domain_delay"),
        (n % 10 == 7).alias("extract_only_metadata"),
    )


def fx_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document, with dates and boilerplate tails injected."""
    return article_rows(read_table(spark, sf_dir, "documents"))


def article_rows(d: DataFrame) -> DataFrame:
    """``documents`` rows (batch or stream) -> article rows."""
    return d.select(
        "doc_id",
        F.col("source").alias("site"),
        F.expr("CAST(substr(source, 4) AS INT)").alias("site_id"),
        F.col("lang").alias("website_category"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'tvbs' WHEN 1 THEN 'udn' WHEN 2 THEN 'setn' "
               "WHEN 3 THEN 'ebc' WHEN 4 THEN 'ctee' ELSE 'other' END").alias("rule_site"),
        F.expr("concat('https://www.', source, '.example.com/', lang, '/', doc_id, "
               "CASE WHEN doc_id % 4 = 0 THEN '?page=1' ELSE '' END)").alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.expr("""concat(
            CASE doc_id % 5 WHEN 0 THEN '2024-01-05 10:20 ' WHEN 1 THEN '2024/02/06 11:21:31 '
              WHEN 2 THEN '2024.03.07 12:22 ' WHEN 3 THEN '2024/3/8 9:05 ' ELSE '' END,
            text,
            CASE doc_id % 7 WHEN 0 THEN concat(chr(10), '影音推薦 tail', chr(10))
              WHEN 1 THEN concat(chr(10), '分享  推薦 x', chr(10), 'y')
              WHEN 2 THEN concat(chr(10), '相關新聞：tail')
              WHEN 3 THEN concat(chr(10), '延伸閱讀：tail', chr(10), chr(10), 'z')
              WHEN 4 THEN ' 三立新聞網 記者王小明／台北報導 body'
              WHEN 5 THEN ' 加入會員 a 閱讀無上限 b' ELSE '' END)""").alias("content"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat(lang, ',', source) END").alias("keywords"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + doc_id * INTERVAL '7' MINUTE")
        .alias("scraped_time"),
    )


def fx_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log derived from ``events`` (event_id is unique)."""
    return fetch_rows(read_table(spark, sf_dir, "events"))


def fetch_rows(e: DataFrame) -> DataFrame:
    """``events`` rows (batch or stream) -> request-log rows."""
    return e.select(
        "event_id", "ts",
        F.expr("concat('www.src', user_id % 20, '.example.com')").alias("domain"),
        F.expr("concat('src', user_id % 20)").alias("site"),
        F.expr("concat('https://www.src', user_id % 20, '.example.com/a/', event_id % 50)").alias("url"),
        F.expr("CAST(event_id % 3 AS INT)").alias("depth"),
        (F.col("event_type") != "error").alias("success"),
        F.expr("""CASE WHEN event_type <> 'error' THEN 200 ELSE CASE event_id % 6 WHEN 0 THEN 429
                  WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 503 ELSE NULL END END""")
        .alias("status_code"),
        F.expr("""CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'TimeoutError'
                  WHEN 1 THEN 'JSONDecodeError' WHEN 2 THEN 'OSError' ELSE 'SSLError' END END""")
        .alias("error_name"),
        "props",
    )


def fx_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs already stored, for the anti-join."""
    return fx_article(spark, sf_dir).filter("doc_id % 3 = 0").select("url")


def fx_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link graph for the frontier walk (start node 'p1'); has cycles."""
    li = read_table(spark, sf_dir, "lineitem")
    a = li.filter("l_linenumber % 2 = 1").select(
        F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    b = li.filter("l_linenumber % 2 = 0").select(
        F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return a.union(b).distinct()


def fx_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated observations of a page element (whole turn text), for change detection."""
    return snapshot_rows(read_table(spark, sf_dir, "conversations"))


def snapshot_rows(c: DataFrame) -> DataFrame:
    return c.select(F.col("conv_id").alias("page_key"), F.col("turn").alias("seq"),
                    F.col("text").alias("element_text"))


def fx_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in ``pages.html``, made absolute against the page's origin."""
    return link_rows(read_table(spark, sf_dir, "pages"))


def link_rows(p: DataFrame) -> DataFrame:
    """``pages`` rows (batch or stream) -> one row per link."""
    h = p.select("page_id", "url", F.posexplode(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "href"))
    return h.select(
        "page_id", "pos", "href",
        F.concat(F.regexp_extract("url", "^([a-z]+)://", 1), F.lit("://"),
                 F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), "href").alias("link"),
    )


def fx_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message payloads: the event ``props`` JSON, blank for every tenth event."""
    return message_rows(read_table(spark, sf_dir, "events"))


def message_rows(e: DataFrame) -> DataFrame:
    return e.select("event_id", "ts",
                    F.expr("CASE WHEN event_id % 10 = 0 THEN '  ' ELSE props END").alias("value"))
