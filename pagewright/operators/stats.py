"""Fetch statistics and run reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .scan import epoch_micros


def articles_total(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count(F.lit(1)).alias("total"))


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Count per value, largest first (ties by value, for a stable order)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def recent(df: DataFrame, ts: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows with ``ts >= as_of - days``; ``as_of`` defaults to max(ts) (a scalar subquery)."""
    if as_of is None:
        as_of = df.select(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def articles_by_date(articles: DataFrame, days: int = 30, shown: int = 10,
                     as_of: Column | None = None) -> DataFrame:
    """Articles per day over the last ``days`` days, newest first; the first ``shown``."""
    r = recent(articles, "scraped_time", days, as_of)
    return (r.groupBy(F.to_date("scraped_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("day")).limit(shown))


def failed_by_status(failed: DataFrame, top: int = 10) -> DataFrame:
    return count_by(failed, "status_code").limit(top)


def site_stats_all(articles: DataFrame, failed: DataFrame, days: int = 30) -> DataFrame:
    """All statistics as long rows (stat, key, value).

    The article statistics (total, per site, per category, per day of the last
    ``days`` days) come from one scan and one aggregation with grouping sets;
    the failed-URL statistics from a second one.
    """
    as_of = articles.select(F.max("scraped_time")).scalar()
    day = F.when(F.col("scraped_time") >= as_of - F.make_dt_interval(F.lit(days)),
                 F.to_date("scraped_time").cast("string"))
    a = articles.select("site", "website_category", day.alias("day"))
    g = a.groupingSets([[], ["site"], ["website_category"], ["day"]], "site", "website_category", "day") \
        .agg(F.count(F.lit(1)).alias("value"), F.grouping_id().alias("gid"))
    # grouping_id bits: site=4, website_category=2, day=1 (1 = not grouped)
    art = g.select(
        F.when(F.col("gid") == 7, F.lit("total_articles")).when(F.col("gid") == 3, F.lit("by_site"))
        .when(F.col("gid") == 5, F.lit("by_category")).otherwise(F.lit("by_date")).alias("stat"),
        F.coalesce("site", "website_category", "day").alias("key"), F.col("value").cast("long"))
    art = art.filter((F.col("stat") != "by_date") | F.col("key").isNotNull())
    failed = cut_lineage(failed.select("url_key", "status_code", "failed_time"))  # built once for both statistics
    recent = (failed.orderBy(F.desc("failed_time"), "url_key").limit(10)
              .select(F.lit("recent_failures").alias("stat"), F.col("url_key").alias("key"),
                      F.floor(epoch_micros("failed_time") / 1000000).cast("long").alias("value")))
    f = failed.groupingSets([[], ["status_code"]], "status_code").agg(
        F.count(F.lit(1)).alias("value"), F.grouping_id().alias("gid"))
    ftotal = f.filter("gid = 1").select(F.lit("total_failed").alias("stat"),
                                        F.lit(None).cast("string").alias("key"), F.col("value").cast("long"))
    fstat = (f.filter("gid = 0").orderBy(F.desc("value"), "status_code").limit(10)
             .select(F.lit("failed_by_status").alias("stat"), F.col("status_code").alias("key"),
                     F.col("value").cast("long")))
    return art.unionByName(ftotal).unionByName(fstat).unionByName(recent)


@F.pandas_udf(T.StringType())
def percent_text(rate: pd.Series) -> pd.Series:
    """Rate as 'xx.xx%' with the same rounding as Python's format (half-even on
    the exact binary value); JVM '%.2f' rounds half-up and differs on ties."""
    return rate.map(lambda r: None if pd.isna(r) else f"{r:.2f}%")


def percent_column(rate) -> Column:
    """``percent_text`` with the package shipped to the Python workers first."""
    from pyspark.sql import SparkSession
    from ..session import ship_package
    ship_package(SparkSession.getActiveSession())
    return percent_text(rate)


def success_rate(success: Column, total: Column) -> Column:
    return F.when(total > 0, success.cast("double") * 100.0 / total).otherwise(F.lit(0.0))


def run_report(fetches: DataFrame, site_col: str = "site") -> DataFrame:
    """Per site: start, end, duration, totals, retries (repeat requests of a URL), rate."""
    g = fetches.groupBy(site_col).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("total_urls"),
        F.count(F.when(F.col("success"), 1)).alias("successful_urls"),
        F.count(F.when(~F.col("success"), 1)).alias("failed_urls"),
        F.count_distinct("url").alias("_distinct"))
    dur = (F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 1000000.0)
    return g.select(
        F.col(site_col).alias("site_name"), "start_time", "end_time", dur.alias("duration_seconds"),
        "total_urls", "successful_urls", "failed_urls",
        (F.col("total_urls") - F.col("_distinct")).alias("retry_urls"),
        success_rate(F.col("successful_urls"), F.col("total_urls")).alias("success_rate"))


def report_document(report: DataFrame, depth: DataFrame, errors: DataFrame) -> DataFrame:
    """The JSON-shaped report: formatted times and rate, depth and error maps."""
    dm = depth.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("depth", "n"))).alias("depth_stats"))
    em = errors.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("error_type", "n")))
                                    .alias("error_types"))
    r = report.join(dm, report.site_name == dm.site, "left").drop("site")
    r = r.join(em, r.site_name == em.site, "left").drop("site")
    return r.select(
        "site_name", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format("end_time", "yyyy-MM-dd HH:mm:ss").alias("end_time"), "duration_seconds",
        "total_urls", "successful_urls", "failed_urls", "retry_urls",
        percent_column("success_rate").alias("success_rate"), "depth_stats", "error_types")


def depth_counts(fetches: DataFrame) -> DataFrame:
    return fetches.filter("success").groupBy("site", "depth").agg(F.count(F.lit(1)).alias("n"))


def error_type_text(fetches: DataFrame) -> Column:
    return F.concat(F.lit("Error: "), F.coalesce("error_name", F.lit("Unknown error")),
                    F.lit(", Status: "), F.coalesce(F.col("status_code").cast("string"), F.lit("None")))


def error_type_counts(fetches: DataFrame) -> DataFrame:
    return (fetches.filter(~F.col("success")).groupBy("site", error_type_text(fetches).alias("error_type"))
            .agg(F.count(F.lit(1)).alias("n")))


def batch_results(fetches: DataFrame) -> DataFrame:
    """Sites whose run produced at least one page, out of all sites run."""
    per_site = fetches.groupBy("site").agg(F.bool_or("success").alias("ok"))
    return per_site.agg(F.count(F.when(F.col("ok"), 1)).alias("n_succeeded"),
                        F.count(F.lit(1)).alias("n_sites"))
