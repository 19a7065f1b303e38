from urllib.parse import urlparse

from pyspark.sql import functions as F

from pagewright.functions import urls as U

URLS = ["https://user:pw@www.example.com:8080/a?b=1#c", "http://my_host.example.com/x",
        "https://bad host.com/path", "www.example.com/no-scheme", "https://news.tvbs.com.tw/life/123",
        "ftp://files.example.org", "https://example.com?x=1"]


def test_domain_is_netloc(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = [r[0] for r in df.select(U.url_domain("url")).collect()]
    assert got == [urlparse(u).netloc for u in URLS]


def test_strip_query(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = [r[0] for r in df.select(U.url_strip_query("url")).collect()]
    assert got == [u.split("?")[0] for u in URLS]


def test_url_valid_three_modes(spark):
    import re
    # Site URLs and patterns.
    cases = [("https://news.tvbs.com.tw/life/123", r"^https://news\.tvbs\.com\.tw/[\w-]+/\d+$", True),
             ("https://news.tvbs.com.tw/life/123/x", r"^https://news\.tvbs\.com\.tw/[\w-]+/\d+$", True),
             ("https://udn.com/news/story/1", "news/story/", False),
             ("https://udn.com/other", "news/story/", False),
             ("https://any.com", "", False),
             ("https://news.ebc.net.tw/news/abc/12345/more", r"^https://news\.ebc\.net\.tw/news/\w+/[0-9]+", True)]
    df = spark.createDataFrame(cases, "url string, pattern string, is_regex boolean")
    got = [r[0] for r in df.select(U.url_valid("url", "pattern", "is_regex")).collect()]
    exp = [True if not p else (bool(re.match(p, u)) if rx else p in u) for u, p, rx in cases]
    assert got == exp


def test_canonical_host(spark):
    df = spark.createDataFrame([("https://www.setn.com/News.aspx?NewsID=1",), ("https://star.setn.com/x",)], "url string")
    out = df.select(U.url_canonical_host("url", F.lit("setn.com"), F.lit("star.setn.com"), F.lit("www.setn.com"),
                                         F.lit("setn.com"))).collect()
    assert [r[0] for r in out] == ["https://setn.com/News.aspx?NewsID=1", "https://star.setn.com/x"]


def test_resolve_link(spark):
    rows = [("https://a.com/x/y.html?q", "/z"), ("https://a.com/x/y.html", "z"), ("https://a.com", "z"),
            ("https://a.com/x", "//b.com/p"), ("https://a.com/x", "http://c.com/")]
    df = spark.createDataFrame(rows, "page string, href string")
    got = [r[0] for r in df.select(U.resolve_link("page", "href")).collect()]
    assert got == ["https://a.com/z", "https://a.com/x/z", "https://a.com/z", "https://b.com/p", "http://c.com/"]
