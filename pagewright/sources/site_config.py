"""Site settings as a small, broadcastable table.

``builtin_sites`` holds the fetcher's configured sites.  ``list_sites``
applies the defaults used when a site leaves a setting out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SITE_CONFIG

DEFAULT_CATEGORY = "unknown"
DEFAULT_SITE_ID = 0
DEFAULT_DOMAIN_DELAY = 3.0


def _sel(name, base, selector):
    return {"name": name, "baseSelector": base,
            "fields": [{"name": "content", "selector": selector, "type": "text", "multiple": True}]}


# The configured sites, in configuration order.
# (site, site_id, website_category, start_urls, url_pattern, is_regex,
#  domain_delay, extract_only_metadata, content_selector)
BUILTIN_SITES = [
    ("udn", 1, "news",
     ["https://udn.com/", "https://udn.com/news/breaknews/1", "https://stars.udn.com/star/index",
      "https://udn.com/news/cate/2/7227"],
     "news/story/", False, 1.0, False,
     _sel("Article", "body", "section.article-content__editor")),
    ("tvbs", 2, "news",
     ["https://news.tvbs.com.tw/", "https://news.tvbs.com.tw/realtime",
      "https://news.tvbs.com.tw/entertainment", "https://news.tvbs.com.tw/life"],
     r"^https://news\.tvbs\.com\.tw/[\w-]+/\d+$", True, 3.5, False,
     _sel("tvbs News Article", "main", "div > article > div > div:nth-child(n)")),
    ("setn", 3, "news",
     ["https://www.setn.com/", "https://www.setn.com/viewall.aspx",
      "https://www.setn.com/viewall.aspx?pagegroupid=0", "https://star.setn.com/viewall"],
     "News.aspx?NewsID=", False, 4.0, False,
     _sel("setn News Article", "#ckuse", "article")),
    ("pixnet", 4, "blog",
     ["https://www.pixnet.net/channel/food", "https://www.pixnet.net/channel/travel",
      "https://www.pixnet.net/channel/family", "https://www.pixnet.net/channel/pet"],
     "blog/post/", False, None, False,
     _sel("Pixnet Article", "#article-box", "div > div.article-body > div.article-content")),
    ("ettoday", 5, "news",
     ["https://www.ettoday.net/", "https://www.ettoday.net/news/news-list.htm",
      "https://star.ettoday.net/", "https://house.ettoday.net/", "https://speed.ettoday.net/"],
     "news/", False, None, False,
     _sel("News Article", "article", "div > div.story")),
    ("chinatimes", 6, "news",
     ["https://www.chinatimes.com/", "https://www.chinatimes.com/life/",
      "https://www.chinatimes.com/realtimenews/", "https://www.chinatimes.com/star/"],
     "realtimenews/", False, None, False,
     _sel("Article", "article", "div > div:nth-child(n) > div.row")),
    ("mobile01", 7, "forum",
     ["https://www.mobile01.com/", "https://www.mobile01.com/category.php?id=6"],
     "topicdetail.php", False, 8.0, False,
     _sel("Article", "div.l-content__main",
          "div:nth-child(n) > div:nth-child(n) > div.l-articlePage__publish > div.u-gapNextV--lg"
          " > div > div > div:nth-child(n)")),
    ("businessToday", 8, "finance_news",
     ["https://www.businesstoday.com.tw/", "https://www.businesstoday.com.tw/catalog/183014",
      "https://www.businesstoday.com.tw/catalog/183007"],
     "article/category/", False, None, False,
     _sel("Article", "div.article__main", "div > div.Zi_ad_ar_iR > div:nth-child(n)")),
    ("Newtalk", 9, "news",
     ["https://newtalk.tw/", "https://newtalk.tw/news/subcategory/1/%E5%9C%8B%E9%9A%9B",
      "https://newtalk.tw/news/subcategory/5/%E7%94%9F%E6%B4%BB"],
     "news/view/", False, None, False,
     _sel("Article", "div.main_content.news_main",
          "div > div.left_column.sticky-main > div.news_content")),
    ("ftvtv", 9, "news",
     ["https://www.ftvnews.com.tw/", "https://www.ftvnews.com.tw/realtime/",
      "https://www.ftvnews.com.tw/popular/"],
     "news/detail/", False, None, False,
     _sel("Article", "div.col-article.position-relative",
          "div.news-article.fitVids > div > #contentarea")),
    ("thenewslens", 10, "news",
     ["https://www.thenewslens.com/", "https://www.thenewslens.com/latest-article",
      "https://www.thenewslens.com/author/BBC"],
     "article/", False, None, False,
     _sel("Article", "article", "section[id^='article-content-']")),
    ("ctee", 11, "finance_news",
     ["https://www.ctee.com.tw/", "https://www.ctee.com.tw/livenews"],
     "article/", False, None, False,
     _sel("Article", "#main", "div.content__body > div.article-wrap")),
    ("tvbs_woman", 12, "beauty_news",
     ["https://woman.tvbs.com.tw/", "https://woman.tvbs.com.tw/master",
      "https://woman.tvbs.com.tw/constellation/page/1"],
     r"^https://woman\.tvbs\.com\.tw/[\w-]+/\d+$", True, None, False,
     _sel("Article", "div.woman_article.min-h-screen",
          r"div.flex.gap-x-\[46px\].desktop-1512\:gap-x-\[60px\] > div")),
    ("gonews", 13, "news",
     ["https://gonews.work/", "https://gonews.work/news/tw"],
     "news/tw/", False, None, False,
     _sel("Article", "section.post-wrap.padding-small", "div > div:nth-child(n) > article > div")),
    ("ftnn", 14, "news",
     ["https://www.ftnn.com.tw/", "https://www.ftnn.com.tw/category/0"],
     "news/", False, None, False,
     _sel("Article", "body", "div:nth-child(n) > div > div.news-show > div.news-box")),
    ("ebc", 15, "news",
     ["https://news.ebc.net.tw/", "https://www.ftnn.com.tw/category/0"],
     r"^https://news\.ebc\.net\.tw/news/\w+/[0-9]+", True, None, False,
     _sel("Article", "div.article_main", "div.article_content")),
    ("businessweekly", 16, "news",
     ["https://www.businessweekly.com.tw/",
      "https://www.businessweekly.com.tw/channel/business/0000000319"],
     r"^https://www\.businessweekly\.com\.tw/\w+/blog/\d+", True, None, False,
     _sel("Article", "section.row.no-gutters.position-relative",
          "div.Single-left-part.col-xs-12.col-md-7.col-lg-8 > section.Single-article")),
    ("sportsv", 17, "sport_news",
     ["https://www.sportsv.net/", "https://www.sportsv.net/basketball",
      "https://www.sportsv.net/baseball", "https://www.sportsv.net/sportslife",
      "https://www.sportsv.net/tennis", "https://www.sportsv.net/football",
      "https://www.sportsv.net/racing"],
     "articles/", False, None, False,
     _sel("Article", "section.article",
          "div > div > div.col-md-10 > div > div.col-md-9 > div.article-content")),
    ("metadata", 99, "metadata",
     ["https://czbooks.net/", "https://www.baozimh.com/", "https://www.timotxt.com/",
      "https://www.xgcartoon.com/", "https://www.twbook.cc/shudan/", "https://18read.net/",
      "https://tw.manhuagui.com/list/view.html", "https://www.novel543.com/",
      "https://daydaynews.cc/zh-tw", "https://www.vivi01.com/", "https://www.idea-novel.work/",
      "https://forum.twbts.com/index.php", "https://memes.tw/", "https://comic.acgn.cc/"],
     "", False, None, True, None),
]


def builtin_sites(spark: SparkSession) -> DataFrame:
    """The configured sites as a DataFrame (bounded: one row per site)."""
    return spark.createDataFrame(BUILTIN_SITES, SITE_CONFIG)


def list_sites(sites: DataFrame) -> DataFrame:
    """Site list with defaults: category ``unknown``, id 0, delay 3.0."""
    return sites.select(
        "site",
        F.coalesce(F.col("site_id"), F.lit(DEFAULT_SITE_ID)).alias("site_id"),
        F.coalesce(F.col("website_category"), F.lit(DEFAULT_CATEGORY)).alias("website_category"),
        F.coalesce(F.col("domain_delay"), F.lit(DEFAULT_DOMAIN_DELAY)).alias("domain_delay"),
    )


def sites_by_category(sites: DataFrame, category: str | Column) -> DataFrame:
    cat = F.lit(category) if isinstance(category, str) else category
    return sites.filter(F.col("website_category") == cat)


def sites_grouped(sites: DataFrame) -> DataFrame:
    """Sites listed under each category, sorted; one row per (category, site)."""
    grouped = sites.groupBy("website_category").agg(
        F.array_sort(F.collect_list("site")).alias("sites"))
    return grouped.select("website_category",
                          F.posexplode("sites").alias("pos", "site"))


OVERRIDE_COLUMNS = ("site_id", "website_category", "start_urls", "url_pattern", "is_regex", "domain_delay",
                    "extract_only_metadata")


def override_sites(sites: DataFrame, overrides_json: DataFrame, value_col: str = "value") -> DataFrame:
    """Apply stored JSON overrides (one object per site, any subset of the
    settings) on top of the built-in site table; a value given in the JSON wins.

    ``overrides_json`` has one JSON text per row, e.g.
    ``{"site": "udn", "domain_delay": 2.0}``.  Both sides are one row per site.
    """
    fields = [f for f in sites.schema.fields if f.name in OVERRIDE_COLUMNS]
    schema = ", ".join(["site string"] + [f"{f.name} {f.dataType.simpleString()}" for f in fields])
    o = overrides_json.select(F.from_json(F.col(value_col), schema).alias("o")).select("o.*")
    o = o.select("site", *[F.col(f.name).alias("o_" + f.name) for f in fields])
    j = sites.join(o, "site", "left")
    return j.select(*[F.coalesce(F.col("o_" + c.name), F.col(c.name)).alias(c.name)
                      if c.name in OVERRIDE_COLUMNS else F.col(c.name) for c in sites.schema.fields])
