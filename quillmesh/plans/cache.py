"""Reads through a table of earlier reads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.plans.options import ReadOptions, cache_key
from quillmesh.plans.read import OUT, read_pages

CACHE_SECONDS = 300
#: what is kept of a read
PAYLOAD = ("final_url", "status", "redirects", "engine", "format", "body", "error")


def read_key(url: Column, options: ReadOptions) -> Column:
    """The key of a read: the page's address with the read's options as sorted parameters."""

    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else cache_key(u, options))

    return keys(url)


def cached_reads(pages: DataFrame, cache: DataFrame | None, now: Column, options: ReadOptions = ReadOptions(), **tables: DataFrame | None) -> DataFrame:
    """The rows of ``read_pages`` with key, fetched_at and cache: HIT where a live entry was found, else MISS.

    ``cache`` (key, fetched_at and what is kept of a read) holds earlier reads; an entry lives
    CACHE_SECONDS.  Only pages without one are read.  Option cache="bypass" reads all.
    """
    asked = pages.withColumn("key", read_key(F.col("url"), options))
    keys = asked.select("page_id", F.col("url").alias("_url"), "key")
    if cache is None or options.cache == "bypass":
        fresh, hits = asked, None
    else:
        live = cache.filter((F.col("fetched_at") > now - F.expr(f"INTERVAL {CACHE_SECONDS} SECONDS")) & (F.col("fetched_at") <= now))
        live = live.groupBy("key").agg(F.max_by(F.struct(*PAYLOAD), "fetched_at").alias("x"), F.max("fetched_at").alias("fetched_at"))
        hits = keys.join(live, "key").select("page_id", *[f"x.{c}" for c in PAYLOAD], "key", "fetched_at", F.lit("HIT").alias("cache"))
        fresh = asked.join(live.select("key"), "key", "left_anti")
    read = read_pages(fresh, options, keep=("key",), **tables)
    misses = read.select(*OUT, "key", now.alias("fetched_at"), F.lit("MISS").alias("cache"))
    return misses if hits is None else misses.unionByName(hits.select(*OUT, "key", "fetched_at", "cache"))


def upsert_cache(cache: DataFrame | None, reads: DataFrame, now: Column) -> DataFrame:
    """The table of reads afterwards: of each key the latest; expired entries go, and reads that failed aren't kept."""
    new = reads.filter("error IS NULL").select("key", "fetched_at", *PAYLOAD)
    every = new if cache is None else cache.select("key", "fetched_at", *PAYLOAD).unionByName(new)
    every = every.filter(F.col("fetched_at") > now - F.expr(f"INTERVAL {CACHE_SECONDS} SECONDS"))
    return every.groupBy("key").agg(F.max("fetched_at").alias("fetched_at"), F.max_by(F.struct(*PAYLOAD), "fetched_at").alias("x")).select("key", "fetched_at", *[f"x.{c}" for c in PAYLOAD])
