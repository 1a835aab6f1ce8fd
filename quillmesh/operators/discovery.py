"""robots.txt, sitemaps and redirects, over a table of resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import trimmed
from quillmesh.functions.urls import resolve_or_null, url_origin
from quillmesh.operators.chains import paths

# Where sitemaps usually are.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml", "/sitemap.txt")
MOST_REDIRECTS, MOST_CHILDREN = 10, 20
#: short rows (an address or two) up to which a table is broadcast, and parts over which common keys are dealt
BROADCAST_ROWS, PARTS = 100_000, 16
REDIRECTS = (301, 302, 303, 307, 308)


def robots_lines(robots: DataFrame) -> DataFrame:
    """(origin, n, key, value, rule): directives in order; each user-agent line opens a rule."""
    lines = robots.select("origin", F.posexplode(F.split("body", "\n", -1)).alias("n", "line"))
    plain = trimmed(F.split_part("line", F.lit("#"), F.lit(1)))
    at = F.instr(plain, ":")
    lines = lines.withColumns({"key": F.lower(trimmed(F.substring_index(plain, ":", 1))), "value": trimmed(F.expr("substring(line, instr(line, ':') + 1)")), "_p": plain, "_at": at})
    lines = lines.withColumn("value", trimmed(F.substring(F.col("_p"), F.col("_at") + 1, F.length("_p")))).filter("_at > 0 AND value <> ''")
    upto = Window.partitionBy("origin").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("rule", F.sum((F.col("key") == "user-agent").cast("int")).over(upto)).select("origin", "n", "key", "value", "rule")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, rule, agent, allow, disallow, crawl_delay); directives before any agent belong to none."""
    values = lambda key: F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == key, F.struct("n", "value")))), lambda x: x["value"])
    rows = robots_lines(robots).filter("rule > 0")
    delay = F.when(F.col("key") == "crawl-delay", F.expr("try_cast(value AS double)"))
    return rows.groupBy("origin", "rule").agg(F.max(F.when(F.col("key") == "user-agent", F.col("value"))).alias("agent"), values("allow").alias("allow"), values("disallow").alias("disallow"), F.max_by(delay, F.when(delay.isNotNull(), F.col("n"))).alias("crawl_delay"))


def robots_sites(robots: DataFrame) -> DataFrame:
    """(origin, sitemaps, host): sitemaps once each in order, the last host."""
    rows = robots_lines(robots)
    maps = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == "sitemap", F.struct("n", "value")))), lambda x: x["value"]))
    return rows.groupBy("origin").agg(maps.alias("sitemaps"), F.max_by(F.when(F.col("key") == "host", F.col("value")), F.when(F.col("key") == "host", F.col("n"))).alias("host"))


def sitemap_hint(robots_body: Column) -> Column:
    """The first absolute sitemap address of a robots file."""
    return F.nullif(F.regexp_extract(robots_body, r"(?im)^sitemap:\s*(https?://\S+)", 1), F.lit(""))


def parsed_sitemap(body: Column) -> Column:
    """struct(kind, urls, sitemaps): an index, a set of addresses, or unknown."""
    found = lambda tag: F.array_distinct(F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}>.*?<loc>\s*([^<\s]+)\s*</loc>.*?</{tag}>"), F.lit(1)))
    children, urls = found("sitemap"), found("url")
    locs = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
    none = F.array().cast("array<string>")
    out = lambda kind, u, s: F.struct(F.lit(kind).alias("kind"), u.alias("urls"), s.alias("sitemaps"))
    return F.when(F.size(children) > 0, out("index", none, children)).when(F.size(urls) > 0, out("urlset", urls, none)).when(body.rlike("(?i)<sitemapindex"), out("index", none, locs)).when(F.size(locs) > 0, out("urlset", locs, none)).otherwise(out("unknown", none, none))


def fetched(resources: DataFrame) -> DataFrame:
    """Resources that answered well."""
    return resources.filter("status BETWEEN 200 AND 299")


def one_each(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each key; of several, the one whose columns come first in order."""
    return table.groupBy(key).agg(F.min(F.struct(*columns)).alias("_x")).select(key, *[f"_x.{c}" for c in columns])


def looked_up(rows: DataFrame, key: Column, table: DataFrame, at: str) -> DataFrame:
    """A left join on ``at``, unique in ``table``; short tables are broadcast, keys that many rows share are dealt over parts."""
    keyed = rows.withColumn("_k", key)
    if table.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(table), F.col("_k") == F.col(at), "left").drop("_k", at)
    keyed = keyed.withColumn("_p", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(PARTS)))
    parts = table.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return keyed.join(parts, (F.col("_k") == F.col(at)) & (F.col("_p") == F.col("_q")), "left").drop("_k", "_p", "_q", at)


def sitemap_candidates(sites: DataFrame, robots: DataFrame, home_links: DataFrame | None = None) -> DataFrame:
    """(origin, pos, candidate): addresses in robots files, linked from home pages (origin, pos, href), then the usual ones."""
    common = F.transform(F.array(*map(F.lit, SITEMAP_PATHS)), lambda p: F.concat(F.col("origin"), p))
    rows = sites.select("origin").distinct().join(robots_sites(robots).select("origin", "sitemaps"), "origin", "left")
    linked = F.array().cast("array<string>")
    if home_links is not None:
        own = home_links.withColumn("url", resolve_or_null(F.col("href"), F.col("origin"))).filter("url IS NOT NULL")
        own = own.groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("_linked"))
        rows = rows.join(own, "origin", "left")
        linked = F.coalesce("_linked", linked)
    every = F.array_distinct(F.concat(F.coalesce("sitemaps", F.array().cast("array<string>")), linked, common))
    return rows.select("origin", F.posexplode(every).alias("pos", "candidate"))


def best_sitemaps(candidates: DataFrame, resources: DataFrame) -> DataFrame:
    """(origin, sitemap_url, sitemap, body): the first candidate that answers and looks like a sitemap."""
    hits = candidates.join(fetched(resources).select(F.col("url").alias("candidate"), F.coalesce("location", "url").alias("final"), F.lower(F.coalesce("content_type", F.lit(""))).alias("ct"), trimmed(F.col("body")).alias("b")), "candidate")
    xml = F.col("ct").contains("xml") | F.col("b").startswith("<?xml") | F.col("b").contains("<urlset") | F.col("b").contains("<sitemapindex")
    fit = hits.filter((F.col("b") != "") & (xml | F.col("ct").contains("text/plain")))
    best = fit.groupBy("origin").agg(F.min_by(F.struct("candidate", "b"), "pos").alias("x"))
    return best.select("origin", F.col("x.candidate").alias("sitemap_url"), parsed_sitemap(F.col("x.b")).alias("sitemap"), F.col("x.b").alias("body"))


def expand_indexes(best: DataFrame, resources: DataFrame, most: int = MOST_CHILDREN) -> DataFrame:
    """(origin, pos, child_url, urls): the first ``most`` children of each index that answer."""
    kids = best.filter("sitemap.kind = 'index'").select("origin", "sitemap_url", F.posexplode(F.slice("sitemap.sitemaps", 1, most)).alias("pos", "child"))
    kids = kids.withColumn("child_url", F.coalesce(resolve_or_null(F.col("child"), F.col("sitemap_url")), "child"))
    found = fetched(resources).select(F.col("url").alias("child_url"), F.col("body").alias("_b"))
    return kids.join(found, "child_url").select("origin", "pos", "child_url", parsed_sitemap(F.col("_b"))["urls"].alias("urls"))


def chase_redirects(requests: DataFrame, resources: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """(url, final_url, status, redirects, error): every request followed to its end.

    ``most`` recorded hops are an error, even if the last one landed.  An address that isn't in the
    table is a failed fetch (502).  Where a redirect leads is worked out once for each address, and whole
    paths by doubling, so requests are joined once, however far they are sent.
    """
    known = one_each(resources, "url", "status", "location")
    moves = known.filter(F.col("status").isin(*REDIRECTS) & (F.coalesce("location", F.lit("")) != ""))
    moves = moves.select(F.col("url").alias("_u"), F.coalesce(resolve_or_null(F.col("location"), F.col("url")), "location").alias("_to"))
    led = paths(moves.select(F.col("_u").alias("u"), F.col("_to").alias("to")), most)
    state = looked_up(requests.select("url"), F.col("url"), led.withColumnRenamed("u", "_u"), "_u").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
    hops = F.size("path")
    asked = F.slice(F.concat(F.array("url"), "path"), F.lit(1), hops)
    state = state.select("url", F.coalesce(F.try_element_at("path", F.lit(-1)), "url").alias("at"), asked.alias("redirects"), (hops >= most).alias("open"))
    ends = state.join(known.select(F.col("url").alias("_u"), F.col("status").alias("_s")), F.col("at") == F.col("_u"), "left")
    error = F.when(F.col("open"), "too many redirects").when(F.col("_s").isNull(), "fetch failed")
    return ends.select("url", F.col("at").alias("final_url"), F.when(error.isNull(), F.col("_s")).otherwise(502).alias("status"), "redirects", error.alias("error"))


def with_companions(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds robots_sitemap, the address that the robots file of each page's site names."""
    files = one_each(fetched(resources).filter(F.col("url").endswith("/robots.txt")), "url", "body")
    hints = files.select(F.col("url").alias("_r"), sitemap_hint(F.col("body")).alias("robots_sitemap")).filter("robots_sitemap IS NOT NULL")
    return looked_up(pages, F.concat(url_origin(F.col("url")), F.lit("/robots.txt")), hints, "_r")
