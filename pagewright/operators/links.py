"""Link operators: pulling links out of pages, filtering, de-duplicating, walking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import hrefs, same_host
from ..functions.urls import resolve_link, url_strip_query, url_valid
from ..session import scratch_path
from .joins import broadcast_bounded


def page_links(pages: DataFrame, internal_only: bool = True) -> DataFrame:
    """One row per ``<a href>`` of a page: (page_id, pos, href, link).

    Links are made absolute against the page URL; external links are dropped
    when ``internal_only``.
    """
    h = pages.select("page_id", "url", F.posexplode(hrefs("html")).alias("pos", "href"))
    h = h.withColumn("link", resolve_link("url", "href"))
    if internal_only:
        h = h.filter(same_host("link", "url"))
    return h.select("page_id", "pos", "href", "link")


def valid_links(links: DataFrame, sites: DataFrame, link_col: str = "url",
                site_col: str = "site") -> DataFrame:
    """Links that pass their site's URL pattern (sites table broadcast)."""
    s = sites.select(F.col("site").alias(site_col), "url_pattern", "is_regex")
    j = links.join(broadcast_bounded(s), site_col, "left")
    return (j.filter(url_valid(link_col, "url_pattern", F.coalesce("is_regex", F.lit(False))))
            .drop("url_pattern", "is_regex"))


def new_links_anti(links: DataFrame, existing: DataFrame, link_col: str = "url") -> DataFrame:
    """Links not already stored.  AQE picks broadcast or sort-merge at runtime."""
    e = existing.select(F.col("url").alias(link_col)).distinct()
    return links.join(e, link_col, "left_anti")


def frontier_anti(next_links: DataFrame, seen: DataFrame, col: str = "link") -> DataFrame:
    """Distinct next-level links minus the seen set."""
    return next_links.select(col).distinct().join(seen.select(F.col(seen.columns[0]).alias(col)),
                                                  col, "left_anti")


def frontier_first_n(links: DataFrame, n: int = 3, site_col: str = "site",
                     link_col: str = "url") -> DataFrame:
    """First ``n`` links per site in URL order (top-k; partial limit before the shuffle)."""
    w = Window.partitionBy(site_col).orderBy(link_col)
    return links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def links_distinct(links: DataFrame, col: str = "link") -> DataFrame:
    return links.select(col).distinct()


def links_union(*frames: DataFrame, col: str = "link") -> DataFrame:
    out = None
    for f in frames:
        f = f.select(F.col(f.columns[0]).alias(col))
        out = f if out is None else out.union(f)
    return out.distinct()


def links_except(left: DataFrame, right: DataFrame, col: str = "link") -> DataFrame:
    """SQL ``EXCEPT`` (distinct): links of ``left`` that never occur in ``right``."""
    return left.select(col).subtract(right.select(F.col(right.columns[0]).alias(col)))


def strip_queries(links: DataFrame, col: str = "link", out: str = "stripped") -> DataFrame:
    return links.withColumn(out, url_strip_query(col))


def frontier_walk(edges: DataFrame, seeds: DataFrame, max_depth: int,
                  max_pages: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Level-by-level walk from the seeds; (node, depth) with the first depth
    reached.  With ``max_pages``, at most that many nodes are taken, level by
    level, in node order inside a level."""
    start = seeds.select(F.lit("").alias("site"), F.col(seeds.columns[0]).alias("node"))
    return site_walks(edges, start, max_depth, max_pages, src, dst).select("node", "depth")


def site_walks(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None,
               src: str = "src", dst: str = "dst") -> DataFrame:
    """One walk for each site, all in one pass; (site, node, depth).

    ``seeds`` has ``site``, ``node`` and, where sites have budgets of their own,
    ``max_pages`` (null: the argument; null too: no limit).  A walk takes its
    seeds, then level by level the pages linked from those of the level before
    that it hasn't taken yet, in node order, until its budget is spent, no page
    is left, or ``max_depth`` levels below the seeds are taken.

    Edges and taken pages are tables in buckets by node, in the shared folder,
    so a level joins edges and taken pages without shuffling either: only the
    links that it finds are dealt out.  A level is one write (two jobs where
    budgets hold); a lost executor repeats tasks of one level.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "walk")
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = root.rsplit("-", 1)[-1]
    edge_table, taken_table = f"pw_edges_{name}", f"pw_taken_{name}"
    # dealt by the same key first, so that a bucket is one file and not one per task
    (edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).repartition(n_buckets, "node")
     .sortWithinPartitions("node").write.bucketBy(n_buckets, "node").option("path", f"{root}/edges")
     .saveAsTable(edge_table))
    own = F.col("max_pages") if "max_pages" in seeds.columns else F.lit(None)
    budget = seeds.groupBy("site").agg(F.max(F.coalesce(own, F.lit(max_pages))).cast("long").alias("budget"))
    budget.write.parquet(f"{root}/budget")
    budget = spark.read.parquet(f"{root}/budget")
    most = budget.agg(F.max("budget")).first()[0]

    def take(found: DataFrame, depth: int) -> bool:
        """Write the pages of a level; whether there are any."""
        if most is not None:
            left = budget
            if depth:
                spent = spark.table(taken_table).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
                left = budget.join(spent, "site", "left").select(
                    "site", (F.col("budget") - F.coalesce("n", F.lit(0))).alias("budget"))
            found = found.join(broadcast_bounded(left), "site")
            # the longest budget limits what leaves a task, each site's own the rest
            order = Window.partitionBy("site").orderBy("node")
            limited = (found.filter(F.col("budget").isNotNull()).withColumn("place", F.row_number().over(order))
                       .filter(F.col("place") <= most).filter(F.col("place") <= F.col("budget")))
            found = limited.select("site", "node").unionByName(
                found.filter(F.col("budget").isNull()).select("site", "node"))
        (found.withColumn("depth", F.lit(depth)).repartition(n_buckets, "node").write.mode("append")
         .partitionBy("depth").bucketBy(n_buckets, "node").option("path", f"{root}/taken").saveAsTable(taken_table))
        return not spark.table(taken_table).filter(F.col("depth") == depth).isEmpty()

    # a walk is part of the key, the buckets go by the node alone
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting, "true")
    spark.conf.set(setting, "false")
    try:
        on = take(seeds.select("site", "node").distinct(), 0)
        for depth in range(1, max_depth + 1):
            if not on:
                break
            taken = spark.table(taken_table)
            found = (taken.filter(F.col("depth") == depth - 1).select("site", "node").join(spark.table(edge_table), "node")
                     .select("site", F.col("next").alias("node")).repartition(n_buckets, "node").distinct()
                     .join(taken.select("site", "node"), ["site", "node"], "left_anti"))
            on = take(found, depth)
        schema = spark.table(taken_table).schema
    finally:
        spark.conf.set(setting, before)
        # the result reads the written pages; the tables are names only
        spark.sql(f"DROP TABLE IF EXISTS {edge_table}")
        spark.sql(f"DROP TABLE IF EXISTS {taken_table}")
    return spark.read.schema(schema).parquet(f"{root}/taken").select("site", "node", "depth")
