"""Page metadata from parse facts: ordered fallbacks, maps, framework rules, sparse records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import EDGE, trimmed
from quillmesh.functions.urls import resolve_or_null, resolve_url


def _first(predicate) -> Column:
    """The first match's content, trimmed; empty is absent."""
    found = F.filter("meta_tags", predicate)
    return F.nullif(trimmed(F.try_element_at(found, F.lit(1))["content"]), F.lit(""))


def meta(name: str) -> Column:
    """A meta tag's content by property, else by name."""
    return F.coalesce(_first(lambda m: m["property"] == name), _first(lambda m: m["name"] == name))


def link(rel: str) -> Column:
    found = F.filter("links", lambda x: x["rel"] == rel)
    return F.nullif(trimmed(F.try_element_at(found, F.lit(1))["href"]), F.lit(""))


def prefixed(prefix: str, by_property: bool = True, by_name: bool = False) -> Column:
    """A map of the tags with a prefix, cut off; of repeated keys the last, untrimmed."""
    n = len(prefix)
    entries = []
    has = lambda c: c.isNotNull() & c.startswith(prefix)
    kept = F.filter("meta_tags", lambda m: (m["content"].isNotNull()) & (m["content"] != ""))
    for name, on in (("name", by_name), ("property", by_property)):
        if on:
            entries.append((name, F.filter(kept, lambda m, name=name: has(m[name]))))
    # name and property of one tag stand side by side, the property after
    pairs = F.flatten(F.transform(kept, lambda m: F.array_compact(F.array(*[F.when(has(m[name]), F.struct(F.substring(m[name], n + 1, 1 << 20).alias("k"), m["content"].alias("v"))) for name, _ in entries]))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))


def class_runs(html: Column) -> Column:
    """What stands in a page's quoted classes, up to the next quote, with quotes between them, as those of the page would stand."""
    return F.array_join(F.regexp_extract_all(html, F.lit('class=(?="([^"]*))'), F.lit(1)), '"')


def frameworks(html: Column) -> Column:
    """Names of the frameworks whose traces a page shows, in the order of the rules."""
    # the classes are taken out of the page once: twelve patterns read them
    return F.element_at(F.transform(F.array(class_runs(html)), lambda runs: _frameworks(html, runs)), 1)


def _frameworks(html: Column, runs: Column) -> Column:
    srcs, inline, generator = F.col("script_srcs"), F.col("inline_scripts"), F.col("generator")
    scripts = F.concat_ws("\n", F.array_join(srcs, "\n"), inline)
    has = lambda *xs: F.greatest(*[html.contains(x) for x in xs], F.lit(False))
    said = lambda *xs: F.greatest(*[scripts.contains(x) for x in xs], F.lit(False))
    id_ = lambda x: F.array_contains("element_ids", x)
    src = lambda x: F.exists(srcs, lambda s: s.contains(x))
    tail = runs.rlike
    # Traces of each framework.
    tailwind = [rf"{EDGE}flex{EDGE}", rf"{EDGE}bg-[a-z]+-[0-9]", rf"{EDGE}text-[a-z]+-[0-9]", rf"{EDGE}min-h-screen{EDGE}", rf"{EDGE}space-x-", rf"{EDGE}divide-y{EDGE}", rf"{EDGE}rounded-[a-z]", rf"{EDGE}px-[0-9]", rf"{EDGE}py-[0-9]"]
    votes = sum((tail(x).cast("int") for x in tailwind), F.lit(0))
    remix_meta = F.exists("meta_tags", lambda m: F.coalesce(m["name"] == "__remix-server", F.lit(False)))
    next_, gatsby, remix = id_("__NEXT_DATA__") | id_("__next") | has("/_next/static/"), id_("___gatsby") | has("/page-data/", "gatsby-focus-wrapper"), remix_meta | inline.contains("__remixContext")
    react = (has("data-reactroot", "__react-root", "__reactFiber$", "_reactListening") | said("react-dom")) & ~next_ & ~gatsby & ~remix
    rules = (
        ("Next.js", next_), ("Nuxt", id_("__NUXT_DATA__") | id_("__nuxt") | has("/_nuxt/", "__NUXT__")), ("Gatsby", gatsby), ("Remix", remix), ("Astro", F.col("has_astro") | tail("astro-[a-zA-Z0-9]")),
        ("Angular", has("ng-version=", "_ngcontent-", "ng-app=", "ng-content")), ("Vue.js", html.contains("data-v-") & html.rlike("data-v-[0-9a-f]+") | has("__VUE__") | F.col("has_cloak")), ("Svelte", has("__sveltekit", "__svelte") | html.contains("svelte-") & html.rlike(rf'{EDGE}class="[^"]*svelte-[a-z0-9]+')),
        ("React", react), ("Webpack", said("webpackChunk", "__webpack_require__", "__webpack_modules__")), ("Vite", src("/@vite/") | said("import.meta.hot", "__vite_ssr_import__")), ("Parcel", said("parcelRequire")),
        ("WordPress", has("wp-content/", "wp-includes/", "wp-json") | generator.contains("wordpress")), ("Shopify", has("cdn.shopify.com", "myshopify.com") | said("Shopify.")), ("Wix", has("wix.com", "wixstatic.com", "wix-warmup-data")),
        ("Squarespace", has("squarespace.com") | tail("sqs-")), ("Webflow", has("webflow.js") | tail("w-[a-z]")), ("Docusaurus", generator.contains("docusaurus") | has("/assets/js/docusaurus") | src("docusaurus")),
        ("Hugo", generator.contains("hugo")), ("Jekyll", generator.contains("jekyll")), ("Eleventy", generator.contains("eleventy")), ("MkDocs", generator.contains("mkdocs") | has("mkdocs-material")),
        ("Tailwind CSS", votes >= 3), ("Bootstrap", has("bootstrap.min.css", "bootstrap.min.js") | src("bootstrap")),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def spread_jsonld(texts: Column) -> Column:
    """The objects of linked data scripts as JSON texts: what isn't JSON is passed over, an array gives its elements."""
    good = F.filter(texts, lambda j: F.try_parse_json(j).isNotNull())
    whole = lambda j: F.when(F.ltrim(j).startswith("["), j).otherwise(F.concat(F.lit("["), j, F.lit("]")))
    each = F.transform(good, lambda j: F.from_json(whole(j), "array<string>", {"allowSingleQuotes": "false"}))
    return F.filter(F.flatten(F.filter(each, lambda x: x.isNotNull())), lambda x: x.startswith("{") | x.startswith("["))


def metadata(facts: DataFrame, *keep: str) -> DataFrame:
    """One row of metadata for each row of facts, which carry the page's HTML; absent values are null.

    A column ``robots_sitemap`` overrides the page's own sitemap link.  Where ``site_kind`` is set and the
    content came from site data, the record has the title (else that of the page's title tag), the
    framework and the fetch alone.  Columns in ``keep`` are carried.
    """
    base = F.col("final_url")
    nonempty = lambda c: F.try_element_at(F.filter(F.array(c), lambda x: F.size(x) > 0), F.lit(1))  # noqa: E731  (a condition would compute it twice)
    robots = F.col("robots_sitemap") if "robots_sitemap" in facts.columns else F.lit(None).cast("string")
    site = F.coalesce("from_site", F.lit(False)) if "site_kind" in facts.columns else None
    read = {
        "title": F.coalesce(meta("og:title"), F.nullif(F.col("title_tag"), F.lit("")), meta("title"), F.col("recovered_title")),
        "description": F.coalesce(meta("og:description"), meta("description"), meta("twitter:description")),
        "site_name": meta("og:site_name"), "author": F.coalesce(meta("author"), meta("article:author")),
        "published_time": F.coalesce(meta("article:published_time"), meta("date")), "modified_time": meta("article:modified_time"),
        "lang": F.nullif(F.col("lang"), F.lit("")), "canonical": resolve_url(link("canonical"), base),
        "image": resolve_url(F.coalesce(meta("og:image"), meta("twitter:image")), base),
        "favicon": F.coalesce(*[resolve_url(link(r), base) for r in ("icon", "shortcut icon", "apple-touch-icon")], resolve_url(F.lit("/favicon.ico"), base)),
        "type": meta("og:type"), "locale": meta("og:locale"),
        "sitemap": F.coalesce(resolve_url(link("sitemap"), base), resolve_or_null(F.lit("/sitemap.xml"), base)), "robots": resolve_or_null(F.lit("/robots.txt"), base),
        "frameworks": nonempty(frameworks(F.col("html"))), "og": nonempty(prefixed("og:")), "twitter": nonempty(prefixed("twitter:", by_name=True)), "jsonld": nonempty(spread_jsonld(F.col("jsonld"))),
    }
    if site is not None:
        of_site = {"title": F.coalesce(F.col("recovered_title"), F.nullif(F.regexp_extract("html", "<title>([^<]+)</title>", 1), F.lit(""))), "frameworks": F.array("site_kind")}
        read = {k: F.when(site, of_site.get(k, F.lit(None))).otherwise(v) for k, v in read.items()}
    read["sitemap"] = F.coalesce(robots, read["sitemap"])
    names = [k for k in read if k not in ("frameworks", "og", "twitter", "jsonld")]
    return facts.select(
        "page_id", "url", "final_url", "status", "content_type", *[read[k].alias(k) for k in names], nonempty(F.col("redirects")).alias("redirects"),
        *[read[k].alias(k) for k in ("frameworks", "og", "twitter", "jsonld")], "engine", *keep,
    )


#: keys of a metadata record, in their order, and the columns that hold them
RECORD = (("url", "url"), ("finalUrl", "final_url"), ("status", "status"), ("contentType", "content_type"), ("title", "title"), ("description", "description"), ("siteName", "site_name"), ("author", "author"), ("publishedTime", "published_time"), ("modifiedTime", "modified_time"), ("lang", "lang"), ("canonical", "canonical"), ("image", "image"), ("favicon", "favicon"), ("type", "type"), ("locale", "locale"), ("sitemap", "sitemap"), ("robots", "robots"), ("redirects", "redirects"), ("frameworks", "frameworks"), ("og", "og"), ("twitter", "twitter"), ("jsonld", "jsonld"))


def record() -> Column:
    """The sparse record of a metadata row as JSON; linked data is put in as it is."""
    body = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in RECORD if c != "jsonld"]))
    linked = F.concat(F.lit(',"jsonld":['), F.array_join("jsonld", ","), F.lit("]}"))
    return F.when(F.col("jsonld").isNull(), body).otherwise(F.concat(F.regexp_replace(body, r"\}$", ""), linked))
