"""Derived inputs shared by several registered queries (all built from the driver tables)."""

from pyspark.sql import functions as F

from ..functions import errors as E
from ..operators import failures as FL
from ..operators.articles import clean_articles
from ..operators.rates import site_domain_delays
from ..sources import fixtures as fx


def failures(spark, sf):
    return FL.failure_record(fx.fx_fetch(spark, sf))


def failed(spark, sf):
    """The failed-URL table after all recorded failures."""
    return FL.failed_upsert(None, failures(spark, sf))


def tasks(spark, sf):
    """Pending and permanent retry tasks after replaying the fetch log."""
    return FL.failure_lifecycle(fx.fx_fetch(spark, sf), E.policy_table(spark))


def cleaned_articles(spark, sf):
    return clean_articles(fx.fx_article(spark, sf), "rule_site")


def delays(spark, sf):
    return site_domain_delays(fx.fx_site(spark, sf))


def as_of(df, col):
    """max(col) as a scalar subquery (no driver round trip)."""
    return df.select(F.max(col)).scalar()
