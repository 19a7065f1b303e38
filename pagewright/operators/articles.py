"""Article pipeline: validation, cleaning, site enrichment, content fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (MAX_CONTENT_CHARS, publish_time_extract, publish_time_nullify,
                              truncate_content)
from ..sources.schemas import REQUIRED_ARTICLE_COLUMNS
from . import rules
from .joins import broadcast_bounded

TEXT_COLUMNS = ("title", "content", "description", "keywords", "url")
HTML_FALLBACK_CHARS = 10000


class MissingColumns(ValueError):
    pass


def required_columns(df: DataFrame, required=REQUIRED_ARTICLE_COLUMNS) -> DataFrame:
    """Fail when any required column is absent (checked on the schema, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df


def fill_text_nulls(df: DataFrame, cols=TEXT_COLUMNS) -> DataFrame:
    """NULL -> '' and cast to string for the text columns that are present."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df


def truncate(df: DataFrame, limit: int = MAX_CONTENT_CHARS) -> DataFrame:
    """Cut content to ``limit`` characters and flag the rows that were cut."""
    return (df.withColumn("content_truncated", F.length("content") > limit)
            .withColumn("content", truncate_content("content", limit)))


def clean_articles(df: DataFrame, site_col: str = "site") -> DataFrame:
    """Base and site cleaning of ``content`` plus the publish time string."""
    d = rules.stage_clean(df, site_col, "content", "_base", "_full", "publish_time")
    return d.withColumn("content", F.col("_full")).drop("_base", "_full")


def enrich_site(df: DataFrame, sites: DataFrame, on: str = "site",
                cols=("site_id", "website_category", "domain_delay")) -> DataFrame:
    """Join the (bounded, one row per site) site table by name, broadcast."""
    s = sites.select(on, *[F.col(c).alias(c) for c in cols])
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep).join(broadcast_bounded(s), on, "left")


def site_by_id(sites: DataFrame) -> DataFrame:
    """id -> site name; on a duplicated id the last definition (highest ord) wins."""
    return sites.groupBy("site_id").agg(F.max_by("site", "ord").alias("site_name"))


def metadata_only(df: DataFrame, flag_col: str = "extract_only_metadata") -> DataFrame:
    return df.withColumn("content", F.when(F.col(flag_col), F.lit("")).otherwise(F.col("content")))


def add_site_columns(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Drop the transient link list and add category, site and site_id."""
    if "next_level_links" in df.columns:
        df = df.drop("next_level_links")
    return enrich_site(df, sites, cols=("site_id", "website_category"))


def extracted_content(extracted, html) -> "F.Column":
    """Content from the extractor's JSON output.

    A JSON list -> its first element; an object -> its ``content`` field; any
    other JSON value -> that value as text; unparseable JSON -> the first
    10,000 characters of the raw HTML.
    """
    x = F.trim(F.col(extracted))
    wrapped = F.concat(F.lit('{"v":'), x, F.lit("}"))
    value = F.get_json_object(wrapped, "$.v")
    elem = F.when(F.startswith(x, F.lit("[")), F.get_json_object(wrapped, "$.v[0]")).otherwise(value)
    from_elem = F.when(F.startswith(F.ltrim(elem), F.lit("{")),
                       F.get_json_object(elem, "$.content")).otherwise(elem)
    return F.when(value.isNull(), F.left(F.col(html), F.lit(HTML_FALLBACK_CHARS))).otherwise(from_elem)


def prepare_article_rows(df: DataFrame) -> DataFrame:
    """Rows as the article table stores them (checked, cleaned, typed)."""
    df = fill_text_nulls(required_columns(df))
    df = truncate(df)
    pt = F.col("publish_time") if "publish_time" in df.columns else F.lit(None).cast("string")
    out = df.withColumn("publish_time", publish_time_nullify(pt.cast("string")))
    for c in ("description", "keywords"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
    return out.select(
        F.col("site_id").cast("int"), "website_category", F.col("scraped_time").cast("timestamp_ntz"),
        "site", "title", "content", "url", "description", "keywords", "publish_time")


__all__ = ["required_columns", "fill_text_nulls", "truncate", "clean_articles", "enrich_site",
           "site_by_id", "metadata_only", "add_site_columns", "extracted_content",
           "prepare_article_rows", "publish_time_extract"]
