"""Robots files and sitemaps of the sites that pages belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.urls import url_origin
from quillmesh.operators import discovery as N
from quillmesh.plans.options import CrawlOptions
from quillmesh.sources.pages import parse_pages, with_fetch_columns


def _robots(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """(origin, body) of every site, null where it has no robots file."""
    sites = pages.select(url_origin(F.col("url")).alias("origin")).filter("origin IS NOT NULL").distinct()
    files = N.one_each(N.fetched(resources).filter(F.col("url").endswith("/robots.txt")), "url", "body")
    return sites.join(files.select(F.col("url").alias("_u"), "body"), F.col("_u") == F.concat("origin", F.lit("/robots.txt")), "left").drop("_u")


def parse_robots(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """(origin, error, code, body, sitemaps, host, rules): each site's robots file, as it is and read; code is 404 where there is none."""
    bodies = _robots(pages, resources)
    rules = N.robots_rules(bodies).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("rule", "agent", "allow", "disallow", "crawl_delay"))).alias("rules"))
    out = bodies.select("origin", F.when(F.col("body").isNull(), "no robots.txt").alias("error"), F.when(F.col("body").isNull(), 404).otherwise(200).alias("code"), "body")
    return out.join(N.robots_sites(bodies), "origin", "left").join(rules, "origin", "left")


def home_links(pages: DataFrame) -> DataFrame:
    """(origin, pos, href): the sitemaps that sites' home pages link to."""
    home = with_fetch_columns(pages).withColumn("origin", url_origin(F.col("url"))).filter(F.regexp_replace("url", "/?(?:[?#].*)?$", "") == F.col("origin"))
    rows = parse_pages(home, want=("facts",), keep=("origin",))
    links = F.filter("links", lambda x: (x["rel"] == "sitemap") & x["href"].isNotNull())
    return rows.select("origin", F.posexplode(links).alias("pos", "x")).select("origin", "pos", "x.href")


def parse_sitemaps(pages: DataFrame, resources: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """(origin, sitemap_url, sitemap, body, error, code, children): each site's best sitemap, as it is and read; code is 404 where there is none.

    Candidates are the sitemaps that the robots file names, those that the home page links to if it is
    among ``pages``, and the usual addresses.
    """
    robots = _robots(pages, resources)
    best = N.best_sitemaps(N.sitemap_candidates(robots, robots.filter("body IS NOT NULL"), home_links(pages)), resources)
    lost = F.col("sitemap_url").isNull()
    out = robots.select("origin").join(best, "origin", "left").withColumns({"error": F.when(lost, "no sitemap"), "code": F.when(lost, 404).otherwise(200)})
    if options.expand:
        kids = N.expand_indexes(best, resources, options.limit).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("pos", "child_url", "urls"))).alias("children"))
        return out.join(kids, "origin", "left")
    return out.withColumn("children", F.lit(None).cast("array<struct<pos:int,child_url:string,urls:array<string>>>"))
