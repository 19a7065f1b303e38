"""Library paths that no registered query exercises."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from pagewright.functions import errors as E
from pagewright.operators import articles as AR
from pagewright.operators import health as HL
from pagewright.operators.scan import trailing_count
from pagewright.sources import readers as RD
from pagewright.sources import schemas as SC
from pagewright.sources import sinks as SK
from pagewright.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def test_ddl_text():
    ddl = SK.table_ddl("article_store", SC.ARTICLE_TABLE, "/data/fetch", ["site"])
    assert ddl.startswith("CREATE TABLE IF NOT EXISTS article_store (") and "`publish_time` timestamp_ntz" in ddl
    assert ddl.endswith("PARTITIONED BY (site) LOCATION '/data/fetch'")


def test_create_table_if_missing_keeps_data(spark):
    path = tempfile.mkdtemp() + "/failed"
    SK.create_table_if_missing(spark, path, SC.FAILED_FETCH)
    rows = spark.createDataFrame([("u", "r", "500", T0, 0, T0)], SC.FAILED_FETCH)
    rows.write.mode("append").parquet(path)
    SK.create_table_if_missing(spark, path, SC.FAILED_FETCH)  # exists: untouched
    assert spark.read.parquet(path).count() == 1


def test_required_columns_and_empty_table_write(spark):
    with pytest.raises(AR.MissingColumns):
        AR.required_columns(spark.createDataFrame([("u",)], "url string"))
    empty = spark.createDataFrame([], "site_id int, website_category string, scraped_time timestamp_ntz, "
                                      "site string, title string, content string, url string")
    assert SK.write_article_table(empty, tempfile.mkdtemp() + "/t") is False


def test_message_and_bulk_files(spark):
    arts = spark.createDataFrame([("u1", "t", "c", "s", "news", 1, T0)],
                                 "url string, title string, content string, site string, "
                                 "website_category string, site_id int, scraped_time timestamp_ntz")
    out = tempfile.mkdtemp()
    SK.write_messages(SK.result_messages(arts.select("url", "title")), out + "/msg")
    back = spark.read.json(out + "/msg").collect()
    assert back[0]["topic"] == "Results" and json.loads(back[0]["value"]) == {"url": "u1", "title": "t"}
    SK.write_bulk_ndjson(SK.index_actions(arts.withColumn("description", F.lit(""))
                                          .withColumn("keywords", F.lit(None).cast("string"))), out + "/bulk")
    lines = [r[0] for r in spark.read.text(out + "/bulk").collect()]
    assert json.loads(lines[0]) == {"index": {"_index": "article_store"}}
    assert json.loads(lines[1])["keywords"] == "" and json.loads(lines[1])["scraped_time"] == "2024-01-01"


def test_publish_stream_file_fallback(spark):
    src = tempfile.mkdtemp()
    spark.createDataFrame([("https://a.com/1",), ("",)], "link string").write.parquet(src + "/in")
    links = S.file_stream(spark, src + "/in", "link string")
    q = S.publish_stream(SK.task_messages(links), src + "/ck", path=src + "/out")
    q.processAllAvailable()
    q.stop()
    got = [r["value"] for r in spark.read.json(src + "/out").collect()]
    assert got == ['{"url":"https://a.com/1"}']


def test_seeded_jitter_in_bounds(spark):
    df = spark.range(2000).select(E.seeded_jitter(F.col("id")).alias("j"))
    lo, hi = df.agg(F.min("j"), F.max("j")).first()
    assert -1.0 <= lo < -0.9 and 0.9 < hi <= 1.0
    d = spark.range(1).select(E.retry_delay_seconds(F.lit(20), F.lit(10.0), F.lit(30.0), F.lit(1.0)).alias("d"))
    assert d.first()["d"] == 3600.0  # capped


def test_global_trailing_count(spark):
    rows = [(i, T0 + dt.timedelta(seconds=25 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")
    got = {r["event_id"]: r["n_trailing"] for r in trailing_count(df, [], "ts", 60_000_000, 5).collect()}
    assert got == {i: min(i + 1, 3) for i in range(40)}


def test_error_sample_and_tail(spark):
    lines = spark.createDataFrame(
        [(T0 + dt.timedelta(seconds=i), f"x {w}", ) for i, w in
         enumerate(["ERROR a", "retry failed", "Fatal b", "ok", "Crash c", "Exception d", "failed e", "error f"])],
        "log_time timestamp_ntz, line string")
    sample = [r["line"] for r in HL.error_sample(lines, 5).collect()]
    assert sample == ["x ERROR a", "x Fatal b", "x Crash c", "x Exception d", "x failed e"]
    assert [r["line"] for r in HL.tail(lines, 2).collect()] == ["x error f", "x failed e"]


def test_scale_conf():
    from pagewright.session import scale_conf
    c = scale_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 416000  # 409,600 rounded up to whole waves
    assert scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "8"
