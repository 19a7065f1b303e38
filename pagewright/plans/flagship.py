"""The flagship pipeline: new, cleaned articles per site and day."""

from pyspark.sql import functions as F

from ..operators import articles as AR
from ..operators import links as LK
from ..sources import fixtures as fx


def new_articles_per_site_day(spark, sf_dir):
    """documents -> articles -> base and site cleaning + publish time ->
    site enrichment (broadcast) -> drop URLs already stored (anti join) ->
    count per site and day."""
    a = AR.clean_articles(fx.fx_article(spark, sf_dir), "rule_site")
    a = AR.enrich_site(a.drop("site_id", "website_category"), fx.fx_site(spark, sf_dir),
                       cols=("site_id", "website_category"))
    a = LK.new_links_anti(a, fx.fx_existing(spark, sf_dir))
    return (a.groupBy("site", "site_id", "website_category", F.to_date("scraped_time").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_articles"),
                 F.count("publish_time").alias("n_with_publish_time"),
                 F.sum(F.length("content")).alias("content_chars")))
