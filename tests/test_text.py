"""Cleaning and date expressions against a plain Python statement of the rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators import rules as R


def py_cut(s, pattern):
    return re.sub(pattern, "", s, flags=re.DOTALL)


def py_base(site, s):
    for p in R.COMMON_CUTS:
        s = py_cut(s, p)
    for p in R.BASE_SITE_CUTS.get(site, []):
        s = py_cut(s, p)
    return s


def py_publish(s):
    for p in X.PUBLISH_TIME_PATTERNS:
        m = re.search(p, s)
        if m:
            d = m.group(1).replace("/", "-").replace(".", "-")
            return d + ":00" if len(d) == 16 else d
    return None


ROWS = [
    "正文 分享　推薦 尾巴",          # ideographic space between the two words
    "正文\r\n分享 推薦 x\r\n",         # CRLF line ends
    "正文\n影音推薦 tail\n",            # trailing newline is kept
    "a 相關新聞 推薦 b\nc",
    "2024-01-05 10:20 text",
    "２０２４-０１-０５ １０:２０ full-width digits",
    "2024/13/40 25:61 invalid but matched",
    "2024.03.07 12:22:59 dotted",
    "no date here",
    "",
]


def _collect(spark, col_fn, rows, site="other"):
    df = spark.createDataFrame([(i, site, r) for i, r in enumerate(rows)], "i int, site string, s string")
    return [r[0] for r in df.orderBy("i").select(col_fn).collect()]


def test_base_cleaning_matches_python(spark):
    for site in ("tvbs", "udn", "setn", "other"):
        got = _collect(spark, R.clean_content(F.col("site"), F.col("s")), ROWS, site)
        assert got == [py_base(site, r) for r in ROWS]


def test_publish_time_matches_python(spark):
    got = _collect(spark, X.publish_time_extract("s"), ROWS)
    assert got == [py_publish(r) for r in ROWS]


def test_invalid_date_parses_to_null(spark):
    got = _collect(spark, X.publish_time_nullify(F.lit("2024-13-40 25:61:00")), ["x"])
    assert got == [None]
    got = _collect(spark, X.publish_time_nullify(F.lit("  ")), ["x"])
    assert got == [None]


def test_strip_and_collapse_match_python(spark):
    rows = ["  a\n \n\n b 　", "\r\nx\n\t\ny\n", "plain"]
    got = _collect(spark, X.collapse_and_strip("s"), rows)
    assert got == [re.sub(r"\n\s*\n", "\n\n", r).strip() for r in rows]


def test_setn_byline_and_source_tag(spark):
    rows = ["三立新聞網／記者王小明／台北報導 正文", "三立新聞網 正文 記者李／台中報導"]
    got = _collect(spark, R.site_content(F.lit("setn"), F.col("s")), rows)
    exp = []
    for r in rows:
        s = py_base("setn", r)
        for p in R.registered_sites()["setn"].steps:
            s = py_cut(s, p)
        exp.append(re.sub(r"\n\s*\n", "\n\n", s).strip())
    assert got == exp


def test_long_content_truncated(spark):
    from pagewright.operators.articles import truncate
    df = spark.createDataFrame([("x" * 70000,), ("short",)], "content string")
    rows = truncate(df).select(F.length("content"), "content_truncated").collect()
    assert [tuple(r) for r in rows] == [(65535, True), (5, False)]


TOKENS = list("ab 分享推薦相關新聞影音延伸閱讀：\n\r\t　") + ["2024-01-05 10:20", "2024/02/06 11:21"]
texts_st = st.lists(st.sampled_from(TOKENS), max_size=30).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(texts_st, min_size=1, max_size=8))
def test_property_cleaning(spark, texts):
    for site in ("tvbs", "udn"):
        assert _collect(spark, R.clean_content(F.col("site"), F.col("s")), texts, site) == \
            [py_base(site, t) for t in texts]
    assert _collect(spark, X.publish_time_extract("s"), texts) == [py_publish(t) for t in texts]
