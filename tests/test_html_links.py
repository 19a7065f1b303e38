"""Links, metadata and URL resolution against html.parser and urljoin."""

import html
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions.urls import resolve_link
from pagewright.operators.failures import failed_for_site
from pagewright.operators.joins import contains_like_join

PAGE = """<head><title>A &mdash; B&#8217;s &#x2019; &bogus; &amp;lt;</title>
<META content='d "q" &eacute;' NAME=description><meta name='keywords' content="a, b"></head>
<a class="x" href="/a">1</a><a href='/b?x=1&amp;y=2'>2</a><A HREF=/c>3</A><a title="x > y" href="d">4</a>
<a name="n">no</a><abbr href="z">no</abbr><a href="">5</a>"""


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.found.append(dict(attrs)["href"])


def test_links_and_metadata(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string")
    m = H.page_metadata("html")
    got = df.select(H.hrefs("html").alias("h"), *[c.alias(k) for k, c in m.items()]).collect()
    parser = Links()
    parser.feed(PAGE)
    assert got[0]["h"] == parser.found and len(parser.found) == 5
    assert got[0]["title"] == html.unescape("A &mdash; B&#8217;s &#x2019; &bogus; &amp;lt;")
    assert (got[0]["description"], got[0]["keywords"]) == ('d "q" é', "a, b")
    assert got[2]["h"] == [] and got[2]["title"] == ""


@pytest.mark.parametrize("page", ["http://h.org/a/b/c?x=1#f", "https://u@h.org:8/", "http://h.org", "http://h.org/a"])
def test_resolve(spark, page):
    hrefs = ["", "#f", "?q=1", "../b", "./b", "b", "/b/../c", "../../../x/.", "x/..", "//o.org/y", "http://z.org/../a",
             "mailto:x@y", "/", "b?x=../y", "a/./b/../c/", "..", "."]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string").withColumn("r", resolve_link(F.lit(page), F.col("h")))
    for r in df.collect():
        want = urljoin(page, r["h"])
        if r["h"] == "http://z.org/../a":
            want = r["h"]  # absolute links stay as written
        assert r["r"] == want, r["h"]


def test_contains_join_without_loose_pairs(spark):
    urls = [f"http://www.src{i}.org/abc_{i % 3}/x%y" for i in range(60)]
    names = ["src1", "SRC59", "abc_2", "x%y", "a%_c", "__", "nope", "www"]
    left = spark.createDataFrame([(u,) for u in urls], "url string")
    right = spark.createDataFrame([(n,) for n in names], "site string")
    got = {(r["url"], r["site"]) for r in contains_like_join(left, "url", right, "site").collect()}
    import re
    like = {n: re.compile(re.escape(n.lower()).replace("_", ".").replace("%", ".*").replace("\\.", "\\."), re.S) for n in names}
    assert got == {(u, n) for u in urls for n in names if like[n].search(u.lower())}
    plain = contains_like_join(left, "url", spark.createDataFrame([("src1",)], "site string"), "site")
    assert "NestedLoop" not in plain._jdf.queryExecution().toString()


def test_linear_retry_has_group_limit(spark):
    from pagewright.plans.catalog import queries
    plan = queries()["linear_retry_delay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert failed_for_site


def test_substring_join_by_rare_grams(spark):
    """Names of ten lengths against a loop; few more candidates than matches;
    with more names than the literal index takes, the same rows."""
    import random
    from pagewright.operators import joins
    rnd = random.Random(8)
    letters = "abcde"
    names = sorted({"".join(rnd.choice(letters) for _ in range(n)) for n in range(1, 11) for _ in range(6)})
    names += ["A_C", "b%d", "%", "_", "ab\\_", "absent-name"]
    urls = [f"HTTPS://x/{''.join(rnd.choice(letters) for _ in range(rnd.randrange(0, 40)))}" for _ in range(120)] + [None, ""]
    left = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    right = spark.createDataFrame([(n,) for n in names], "site string")
    like = left.crossJoin(right).filter("lower(url) LIKE '%' || lower(site) || '%'")
    want = sorted((r.id, r.site) for r in like.collect())
    for most in (2000, 3):
        got = sorted((r.id, r.site) for r in joins.contains_like_join(left, "url", right, "site", 4, most).collect())
        assert got == want
    assert joins.contains_like_join(left, "url", right.limit(0), "site").count() == 0


def test_few_more_candidates_than_matches(spark):
    """Names of ten lengths: texts meet little more names than they contain."""
    import random
    from pagewright.operators import joins
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4 + i % 10)) for i in range(60)]
    urls = [f"https://www.{rnd.choice(names)}.example.com/{rnd.randrange(10 ** 6)}/page" for _ in range(1000)]
    left = spark.createDataFrame([(u,) for u in urls], "url string")
    right = spark.createDataFrame([(n,) for n in names], "site string")
    matches = joins.contains_like_join(left, "url", right, "site").count()
    grams = right.select(F.col("site").alias("_piece"),
                         F.explode(joins._grams("site", F.least(F.length("site"), F.lit(6)))).alias("_gram"))
    lengths, wanted, chosen = joins._rarest_grams(left.select(F.col("url").alias("_text")), grams, 6, 2000)
    cut = left.withColumn("_gram", F.explode(joins._grams_in(F.col("url"), lengths, wanted)))
    candidates = cut.join(chosen, "_gram").count()
    assert matches == 1000 and matches <= candidates <= 2 * matches
