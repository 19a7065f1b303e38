from pyspark.sql import functions as F

from pagewright.sources import readers as RD
from pagewright.sources import sinks as SK


def test_blank_and_null_payloads(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "   "), (3, None), (4, "not json")], "id int, value string")
    got = {r["id"]: r["message"] for r in RD.parse_messages(df, "k int").collect()}
    assert got[1]["k"] == 3 and got[2] is None and got[3] is None
    assert got[4] is None or got[4]["k"] is None


def test_task_message_without_url_rejected(spark):
    df = spark.createDataFrame([("https://a.com/1",), ("",), (None,)], "link string")
    got = [r["value"] for r in SK.task_messages(df).collect()]
    assert got == ['{"url":"https://a.com/1"}']


def test_index_strict_needs_non_empty(spark):
    df = spark.createDataFrame([("u1", "t", "c"), ("u2", "", "c"), ("u3", None, "c")], "url string, title string, content string")
    assert sorted(r["url"] for r in SK.index_required(df).collect()) == ["u1", "u2"]
    assert [r["url"] for r in SK.index_required_strict(df).collect()] == ["u1"]


def test_metadata_non_empty_case(spark):
    from pagewright.functions.html import page_metadata
    html = ('<html><head><title>T &amp; U</title><meta name="description" content="D &lt;x&gt;">'
            '<meta name="keywords" content="k1,k2"></head></html>')
    df = spark.createDataFrame([(html,)], "html string")
    m = page_metadata("html")
    r = df.select(m["title"], m["description"], m["keywords"]).first()
    assert tuple(r) == ("T & U", "D <x>", "k1,k2")


def test_csv_roundtrip_keeps_text(spark, tmp_path):
    from pyspark.sql import types as T
    rows = [(1, 'quote " and, comma', "line1\nline2 ", "s", 1), (2, "  lead", "", "s", 2)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType()),
                           T.StructField("content", T.StringType()), T.StructField("site", T.StringType()),
                           T.StructField("depth", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    SK.write_article_csv(df, str(tmp_path / "csv"))
    back = SK.read_csv(spark, str(tmp_path / "csv"), schema).orderBy("doc_id").collect()
    assert [(r.doc_id, r.title, r.content) for r in back] == [(1, 'quote " and, comma', "line1\nline2 "), (2, "  lead", None)] \
        or [(r.doc_id, r.title, r.content) for r in back] == [(1, 'quote " and, comma', "line1\nline2 "), (2, "  lead", "")]


def test_site_overrides(spark):
    from pagewright.sources.site_config import builtin_sites, override_sites
    s = builtin_sites(spark)
    ov = spark.createDataFrame([('{"site": "udn", "domain_delay": 2.5, "url_pattern": "news/"}',),
                                ('{"site": "pixnet", "website_category": "food"}',)], "value string")
    got = {r["site"]: r for r in override_sites(s, ov).collect()}
    assert got["udn"]["domain_delay"] == 2.5 and got["udn"]["url_pattern"] == "news/"
    assert got["udn"]["site_id"] == 1 and got["pixnet"]["website_category"] == "food"
    assert got["tvbs"]["domain_delay"] == 3.5 and len(got) == 19


def test_builtin_sites_and_id_lookup(spark):
    from pagewright.operators.articles import site_by_id
    from pagewright.operators.rates import domain_delay_lookup, site_domain_delays
    from pagewright.sources.site_config import builtin_sites, list_sites
    s = builtin_sites(spark)
    assert s.count() == 19
    ids = {r["site_id"]: r["site_name"] for r in site_by_id(s.withColumn("ord", F.monotonically_increasing_id()))
           .collect()}
    assert ids[9] == "ftvtv" and ids[1] == "udn" and 4 in ids
    delays = {r["domain"]: r["domain_delay"] for r in site_domain_delays(s).collect()}
    assert delays == {"udn.com": 1.0, "news.tvbs.com.tw": 3.5, "www.setn.com": 4.0, "www.mobile01.com": 8.0}
    d = spark.createDataFrame([("udn.com",), ("www.pixnet.net",)], "domain string")
    got = {r["domain"]: r["domain_delay"] for r in domain_delay_lookup(d, site_domain_delays(s)).collect()}
    assert got == {"udn.com": 1.0, "www.pixnet.net": 3.0}
    listed = {r["site"]: r for r in list_sites(s).collect()}
    assert listed["pixnet"]["domain_delay"] == 3.0 and listed["metadata"]["site_id"] == 99
