"""Record schemas (FIXTURES.md section 1) as explicit Spark types."""

from pyspark.sql import types as T

FIELD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("multiple", T.BooleanType()),
])

SELECTOR = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("baseSelector", T.StringType()),
    T.StructField("fields", T.ArrayType(FIELD)),
])

SITE_CONFIG = T.StructType([
    T.StructField("site", T.StringType(), False),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("website_category", T.StringType()),
    T.StructField("start_urls", T.ArrayType(T.StringType())),
    T.StructField("url_pattern", T.StringType()),
    T.StructField("is_regex", T.BooleanType()),
    T.StructField("domain_delay", T.DoubleType()),
    T.StructField("extract_only_metadata", T.BooleanType()),
    T.StructField("content_selector", SELECTOR),
])

# article_store table: the columns written by the article sink, in table order
ARTICLE_TABLE = T.StructType([
    T.StructField("site_id", T.IntegerType(), False),
    T.StructField("website_category", T.StringType(), False),
    T.StructField("scraped_time", T.TimestampNTZType(), False),
    T.StructField("site", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("publish_time", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

REQUIRED_ARTICLE_COLUMNS = ("site_id", "website_category", "scraped_time", "site",
                            "title", "content", "url")

FAILED_FETCH = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("status_code", T.StringType(), False),
    T.StructField("failed_time", T.TimestampNTZType(), False),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

FAILED_TASK = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("site_name", T.StringType()),
    T.StructField("error_category", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("first_failed_at", T.TimestampNTZType()),
    T.StructField("last_failed_at", T.TimestampNTZType()),
    T.StructField("next_retry_at", T.TimestampNTZType()),
    T.StructField("extra_data", T.MapType(T.StringType(), T.StringType())),
])

# the snapshot file stores times as 'yyyy-MM-dd HH:mm:ss' strings
FAILED_TASK_FILE = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("site_name", T.StringType()),
    T.StructField("error_category", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("first_failed_at", T.StringType()),
    T.StructField("last_failed_at", T.StringType()),
    T.StructField("next_retry_at", T.StringType()),
    T.StructField("extra_data", T.MapType(T.StringType(), T.StringType())),
])

FETCH_REPORT = T.StructType([
    T.StructField("site_name", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("total_urls", T.LongType()),
    T.StructField("successful_urls", T.LongType()),
    T.StructField("failed_urls", T.LongType()),
    T.StructField("retry_urls", T.LongType()),
    T.StructField("success_rate", T.StringType()),
    T.StructField("depth_stats", T.MapType(T.StringType(), T.LongType())),
    T.StructField("error_types", T.MapType(T.StringType(), T.LongType())),
])

TASK_MESSAGE = T.StructType([T.StructField("url", T.StringType())])

INDEX_DOCUMENT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("website_category", T.StringType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("scraped_time", T.DateType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

LOG_LINE = T.StructType([T.StructField("value", T.StringType())])
