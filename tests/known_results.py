"""Queries over small fixtures with their known results: what the tables don't show; see test_queries."""

from __future__ import annotations

from golden import RICH_BODIES
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions import urls as U
from quillmesh.operators import classify as C
from quillmesh.operators import diff as D
from quillmesh.operators import discovery as N
from quillmesh.operators import graph as K
from quillmesh.operators import linking as L
from quillmesh.operators.markdown_blocks import markdown_blocks
from quillmesh.operators.metadata import metadata
from quillmesh.operators.sections import flattened
from quillmesh.plans.options import ReadOptions, cache_key, request_headers, resolve_agent
from quillmesh.plans.read import read_pages
from quillmesh.sources.pages import exploded, jsonld_nodes, page_blocks, page_facts, parse_pages, reconstructed, with_fetch_columns

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Registers a query under its name with its known result as SQL values."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def _values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


@query("SELECT * FROM (VALUES ('Example.COM/a', 'https://example.com/a'), ('http:/x.org', 'http://x.org/'), ('HTTP://X.org:80/%7Ea/../b?q=a b#f', 'http://x.org/b?q=a%20b#f'), ('https://x.org:8080/./', 'https://x.org:8080/'), ('  ', NULL), ('http://', NULL)) AS t(raw, url)")
def url_normalize(spark, sf_dir):
    rows = spark.createDataFrame([("Example.COM/a",), ("http:/x.org",), ("HTTP://X.org:80/%7Ea/../b?q=a b#f",), ("https://x.org:8080/./",), ("  ",), ("http://",)], "raw string")
    return rows.select("raw", U.normalize_url(F.col("raw")).alias("url"))


@query("SELECT * FROM (VALUES ('a', 'https://x.org/d/e?q', 'https://x.org/d/a'), ('../a', 'https://x.org/d/e/f', 'https://x.org/d/a'), ('/r', 'https://x.org/d', 'https://x.org/r'), ('//y.org/z', 'https://x.org/', 'https://y.org/z'), ('?n=1', 'https://x.org/d/e?q', 'https://x.org/d/e?n=1'), ('#f', 'https://x.org/d', 'https://x.org/d#f'), ('mailto:a@b.c', 'https://x.org/', 'mailto:a@b.c'), ('http://', 'https://x.org/', 'http://')) AS t(href, base, url)")
def url_resolve(spark, sf_dir):
    rows = spark.createDataFrame([("a", "https://x.org/d/e?q"), ("../a", "https://x.org/d/e/f"), ("/r", "https://x.org/d"), ("//y.org/z", "https://x.org/"), ("?n=1", "https://x.org/d/e?q"), ("#f", "https://x.org/d"), ("mailto:a@b.c", "https://x.org/"), ("http://", "https://x.org/")], "href string, base string")
    return rows.select("href", "base", U.resolve_url(F.col("href"), F.col("base")).alias("url"))


@query("SELECT * FROM (VALUES (1, '<span>a</span> <span>b</span>', 'x' || chr(10) || chr(10) || 'y'), (2, '<h1>a</h1> <h2>>b</h2>', 'p' || chr(10) || 'q'), (3, '<a>x</a> <a>y</a><b></b>', '')) AS t(id, spaced, collapsed)")
def space_and_collapse(spark, sf_dir):
    rows = spark.createDataFrame([(1, "<span>a</span><span>b</span>", " x \t\r\n\n\n\ny\n"), (2, "<h1>a</h1>\n<h2>b</h2>", "p\r\nq"), (3, "<a>x</a><a>y</a><b></b>", " \n ")], "id int, h string, t string")
    return rows.select("id", T.space_injection(F.col("h")).alias("spaced"), T.collapse_whitespace(F.col("t")).alias("collapsed"))


_META_PAGE = """<html lang="en"><head><title> T </title><meta property="og:title" content=" OG "><meta name="og:title" content="N"><meta property="og:image" content="/i.png"><meta property="og:image" content="/j.png"><meta name="twitter:card" content="s"><meta property="twitter:card" content="p"><meta name="author" content="Ann Lee"><meta property="article:published_time" content="2024-05-06"><link rel="apple-touch-icon" href="/t.png"><link rel="canonical" href="/c"><meta name="generator" content="Hugo 0.1"><script type="application/ld+json">[{"@type":"Product","@id":"#p","name":"Lamp"},{"@context":"x","@graph":[{"@type":"schema:Article","@id":"#a","author":{"name":"Ann Lee"}}]}]</script><script type="application/ld+json">{bad</script></head><body><div class="flex px-2 py-3 bg-red-5">Lamp by Ann Lee on 2024-05-06</div></body></html>"""


def _meta_page(spark):
    return with_fetch_columns(spark.createDataFrame([(1, "https://x.org/d/p", _META_PAGE)], "page_id long, url string, html string"))


@query("SELECT 1 AS page_id, 'OG' AS title, 'https://x.org/i.png' AS image, 'https://x.org/t.png' AS favicon, 'https://x.org/c' AS canonical, 'Ann Lee' AS author, '2024-05-06' AS published_time, '/j.png' AS og_image, 'p' AS twitter_card, 'Hugo,Tailwind CSS' AS frameworks")
def meta_precedence(spark, sf_dir):
    m = metadata(page_facts(_meta_page(spark)))
    return m.select(F.col("page_id").cast("int").alias("page_id"), "title", "image", "favicon", "canonical", "author", "published_time", F.col("og")["image"].alias("og_image"), F.col("twitter")["card"].alias("twitter_card"), F.array_join("frameworks", ",").alias("frameworks"))


@query("SELECT * FROM (VALUES (0, '#p', 'Product'), (1, '#a', 'schema:Article')) AS t(node_ord, id, type)")
def jsonld_harvest(spark, sf_dir):
    return jsonld_nodes(page_facts(_meta_page(spark))).select("node_ord", "id", F.element_at("types", 1).alias("type"))


@query("SELECT '#p' AS main_id")
def graph_main_entity(spark, sf_dir):
    return page_facts(_meta_page(spark)).select(K.main_id(F.col("linked")).alias("main_id"))


@query("SELECT 'date' AS classification, 0.9::DOUBLE AS confidence")
def classify_hints(spark, sf_dir):
    """A publication time beats an author, which beats linked data."""
    rows = metadata(parse_pages(_meta_page(spark), want=("facts", "linked", "blocks")), "linked", "blocks")
    rows = rows.withColumn("hints", C.linked_hints(F.col("linked")))
    found = C.classify(exploded(rows, "hints", "author", "published_time"))
    return found.filter("type = 'paragraph'").select("classification", "confidence")


_MD = "# T\ntext\n- a\n* [b](u)\n1. c\n\n> q\n![i](s)\n[l](h)\n```py\nx = 1\n\ny\n```\n```\nlost"


@query("SELECT * FROM (VALUES (0, 'heading', 'T', NULL), (1, 'paragraph', 'text', NULL), (2, 'list', 'a|b', NULL), (3, 'list', 'c', NULL), (4, 'blockquote', 'q', NULL), (5, 'image', 'i', 's'), (6, 'link', 'l', 'h'), (7, 'code', 'x = 1' || chr(10) || chr(10) || 'y', 'py')) AS t(ord, type, said, target)")
def markdown_forms(spark, sf_dir):
    blocks = markdown_blocks(spark.createDataFrame([(1, _MD)], "id long, md string"), "id", "md")
    items = F.array_join(F.transform("items", lambda i: i["text"]), "|")
    return blocks.select("ord", "type", F.coalesce("text", "code", "alt", items).alias("said"), F.coalesce("href", "src", "language").alias("target"))


_ROBOTS = "# c\nUser-agent: a\nUser-agent: b # x\nAllow: /p\nDisallow:\nDisallow: /q\nCrawl-delay: 2.5\nSitemap: https://x.org/s.xml\nsitemap: https://x.org/s.xml\nHost: x.org"


def _robots(spark):
    return spark.createDataFrame([("https://x.org", _ROBOTS)], "origin string, body string")


@query("SELECT * FROM (VALUES (1, 'a', '', '', NULL::DOUBLE), (2, 'b', '/p', '/q', 2.5)) AS t(rule, agent, allow, disallow, crawl_delay)")
def robots_rules(spark, sf_dir):
    return N.robots_rules(_robots(spark)).select(F.col("rule").cast("int").alias("rule"), "agent", F.array_join("allow", ",").alias("allow"), F.array_join("disallow", ",").alias("disallow"), "crawl_delay")


@query("SELECT 'https://x.org/s.xml' AS sitemaps, 'x.org' AS host, 'https://x.org/s.xml' AS hint")
def robots_sitemaps(spark, sf_dir):
    return N.robots_sites(_robots(spark)).join(_robots(spark), "origin").select(F.array_join("sitemaps", ",").alias("sitemaps"), "host", N.sitemap_hint(F.col("body")).alias("hint"))


_MAPS = [("https://x.org/s.xml", 200, "application/xml", None, "<sitemapindex><sitemap><loc> https://x.org/1.xml </loc></sitemap><sitemap><loc>/2.xml</loc></sitemap></sitemapindex>"), ("https://x.org/1.xml", 200, "text/xml", None, "<urlset><url><loc>https://x.org/a</loc></url><url><loc>https://x.org/a</loc></url></urlset>"), ("https://x.org/2.xml", 200, "text/xml", None, "<loc>https://x.org/b</loc>"), ("https://x.org/sitemap.xml", 404, "text/html", None, "no"), ("https://x.org/sitemap.txt", 200, "text/plain", None, "https://x.org/t")]


def _resources(spark):
    return spark.createDataFrame(_MAPS, "url string, status int, content_type string, location string, body string")


@query("SELECT * FROM (VALUES ('https://x.org/s.xml', 'index', '', 'https://x.org/1.xml,/2.xml'), ('https://x.org/1.xml', 'urlset', 'https://x.org/a', ''), ('https://x.org/2.xml', 'urlset', 'https://x.org/b', ''), ('https://x.org/sitemap.xml', 'unknown', '', ''), ('https://x.org/sitemap.txt', 'unknown', '', '')) AS t(url, kind, urls, sitemaps)")
def sitemap_parse(spark, sf_dir):
    x = N.parsed_sitemap(F.col("body"))
    return _resources(spark).select("url", x["kind"].alias("kind"), F.array_join(x["urls"], ",").alias("urls"), F.array_join(x["sitemaps"], ",").alias("sitemaps"))


def _best(spark):
    sites = spark.createDataFrame([("https://x.org",)], "origin string")
    return N.best_sitemaps(N.sitemap_candidates(sites, _robots(spark)), _resources(spark))


@query("SELECT 'https://x.org' AS origin, 'https://x.org/s.xml' AS sitemap_url, 'index' AS kind")
def sitemap_best(spark, sf_dir):
    return _best(spark).select("origin", "sitemap_url", F.col("sitemap.kind").alias("kind"))


@query("SELECT * FROM (VALUES (0, 'https://x.org/1.xml', 'https://x.org/a'), (1, 'https://x.org/2.xml', 'https://x.org/b')) AS t(pos, child_url, urls)")
def sitemap_expand(spark, sf_dir):
    return N.expand_indexes(_best(spark), _resources(spark)).select("pos", "child_url", F.array_join("urls", ",").alias("urls"))


@query("SELECT 'https://x.org/0' AS url, 'https://x.org/9' AS final_url, 200 AS status, 9 AS hops, NULL::VARCHAR AS error UNION ALL SELECT 'https://y.org/0', 'https://y.org/10', 502, 10, 'too many redirects' UNION ALL SELECT 'https://z.org/', 'https://z.org/', 502, 0, 'fetch failed'")
def redirect_chase(spark, sf_dir):
    """Nine hops land, ten are an error, and what isn't there fails."""
    rows = [(f"https://{h}.org/{k}", 302 if k < n else 200, str(k + 1) if k < n else None) for h, n in (("x", 9), ("y", 10)) for k in range(n + 1)]
    table = spark.createDataFrame(rows, "url string, status int, location string")
    asked = spark.createDataFrame([("https://x.org/0",), ("https://y.org/0",), ("https://z.org/",)], "url string")
    return N.chase_redirects(asked, table).select("url", "final_url", "status", F.size("redirects").alias("hops"), "error")


_NODES = [(1, 0, "#a", ["Person"], " Ada ", None, None, None, None, None), (1, 1, "#b", ["WebPageElement"], None, "Berlin city", None, None, None, None), (1, 2, "#c", ["Table"], "No", None, None, None, None, None), (1, 3, "#d", ["http://schema.org/Place"], "Rome", None, None, None, None, ["https://www.wikidata.org/wiki/Q220"]), (1, 4, "#e", [], "Unknown", None, None, None, None, None)]
_NODE_DDL = "page_id long, node_ord int, id string, types array<string>, name string, headline string, pref_label string, rdf_label string, text string, same_as array<string>"
_KB = [("Ada", 1, "Q1", "Ada Lovelace", "alias"), ("Ada", 2, "Q2", "Ada", "label"), ("Berlin city", 1, "Q64", "Berlin", "alias"), ("Unknown", 1, "Q9", "Other", "alias")]


def _candidates(spark):
    return L.candidates(spark.createDataFrame(_NODES, _NODE_DDL))


def _entity_links(spark):
    return L.resolve(_candidates(spark), spark.createDataFrame(_KB, "search_label string, rank int, qid string, label string, match_type string"))


@query("SELECT * FROM (VALUES ('#a', 'Ada', NULL), ('#b', 'Berlin city', NULL), ('#d', 'Rome', 'Q220'), ('#e', 'Unknown', NULL)) AS t(id, label, existing_qid)")
def link_candidates(spark, sf_dir):
    return _candidates(spark).select("id", "label", "existing_qid")


@query("SELECT * FROM (VALUES ('#a', 'Q1', 'Ada Lovelace', 'exact'), ('#b', 'Q64', 'Berlin', 'exact'), ('#d', 'Q220', NULL, 'exact')) AS t(id, qid, label, confidence)")
def entity_link(spark, sf_dir):
    return _entity_links(spark).select("id", "qid", "label", "confidence")


@query("SELECT * FROM (VALUES ('#a', 'Ada', 'http://www.wikidata.org/entity/Q1'), ('#b', 'Berlin', 'http://www.wikidata.org/entity/Q64'), ('#c', 'No', NULL), ('#d', 'Rome', 'https://www.wikidata.org/wiki/Q220,http://www.wikidata.org/entity/Q220'), ('#e', 'Unknown', NULL)) AS t(id, name, same_as)")
def entity_attach(spark, sf_dir):
    out = L.attach(spark.createDataFrame(_NODES, _NODE_DDL), _entity_links(spark))
    return out.select("id", F.trim("name").alias("name"), F.array_join("same_as", ",").alias("same_as"))


@query("SELECT 'http://www.wikidata.org/entity/Q64' AS id, 'Berlin' AS label, 'city' AS definition, 'wdt:P31=http://www.wikidata.org/entity/Q515;wdt:P569=1237-01-01,1307-01-01;wdt:P856=https://berlin.de' AS claims")
def entity_nodes(spark, sf_dir):
    claims = [("P856", 0, "string", '"https://berlin.de"'), ("P31", 0, "wikibase-entityid", '{"id":"Q515"}'), ("P569", 0, "time", '{"time":"+1237-01-01T00:00:00Z"}'), ("P569", 1, "time", '{"time":"+1307-01-01T00:00:00Z"}'), ("P625", 0, "globecoordinate", "{}")]
    kb = spark.createDataFrame([("Q64", {"de": "Berlin"}, {"en": "city"}, claims), ("Q0", {}, {}, [])], "qid string, labels map<string,string>, descriptions map<string,string>, claims array<struct<property:string,rank:int,type:string,value:string>>")
    told = F.array_join(F.transform("claims", lambda c: F.concat(c["prop"], F.lit("="), F.array_join(c["values"], ","))), ";")
    return L.entity_nodes(_entity_links(spark), kb).select("id", "label", "definition", told.alias("claims"))


@query("SELECT * FROM (VALUES (1, 'html', '<p>a <strong>b</strong></p>' || chr(10) || '<h2>c</h2>' || chr(10)), (2, 'text', '<p>' || repeat('word ', 12) || '</p>'), (3, NULL, NULL)) AS t(id, kind, html)")
def reconstruct_best(spark, sf_dir):
    rows = [(1, '{"x":[{"_type":"block","children":[{"text":"a "},{"text":"b","marks":["strong"]}]},{"_type":"block","style":"h2","children":[{"text":"c"}]}]}'), (2, '{"body":"' + "word " * 12 + '","z":"' + "long " * 30 + '"}'), (3, "{bad")]
    out = reconstructed(spark.createDataFrame(rows, "id int, j string"), "j")
    return out.select("id", "best.kind", "best.html")


@query("SELECT 'https://q.org/read?_classify=1&_format=json&_marker=date%2Clink&a=1' AS key, 13 AS n_browser, 3 AS n_bot, true AS is_preset")
def request_options(spark, sf_dir):
    key = cache_key("https://q.org/read?a=1", ReadOptions(format="json", marker=("date", "link"), classify=True))
    row = (key, len(request_headers(resolve_agent(None))), len(request_headers(resolve_agent("GoogleBot"))), resolve_agent("CHROME") == resolve_agent(None))
    return spark.createDataFrame([row], "key string, n_browser int, n_bot int, is_preset boolean")


_SNAP_SQL = "SELECT * FROM (VALUES ('added', 'new', NULL), ('changed', NULL, NULL), ('removed', 'old', NULL), ('unchanged', 'same', NULL)) AS t(change, said, classification)"


@query(_SNAP_SQL)
def diff_kinds(spark, sf_dir):
    """An edited text is removed and added; a list whose links alone differ is changed."""
    ddl = "url string, ord int, type string, text string, code string, href string, src string, alt string, ordered boolean, items array<struct<text:string,href:string>>, headers array<string>, rows array<array<string>>, html_id string, html_class string"

    def side(*blocks):
        rows = [("u", k, b[0], b[1], None, None, None, None, False, b[2], None, None, None, None) for k, b in enumerate(blocks)]
        return D.keyed(spark.createDataFrame(rows, ddl))

    before = side(("paragraph", "same", None), ("paragraph", "old", None), ("list", None, [("x", "/1")]))
    after = side(("paragraph", "new", None), ("list", None, [("x", "/2")]), ("paragraph", "same", None))
    out = D.changes(before, after)
    said = F.when(F.col("change") != "changed", F.coalesce("after", "before"))
    return out.select("change", said.alias("said"), "classification")


# -- whole pages of every kind of block --------------------------------------------------------------
_RICH = """<html lang="en"><head><title>T</title><meta name="author" content="Ann Lee"><meta name="description" content="D"></head><body><p id="i" class="c d">by Ann Lee</p><h1>A <em>b</em></h1><div><section><h2>in</h2><p><img src="i.png" alt="x"></p></section><p><a href="/l">go</a></p></div><blockquote>q *r*</blockquote><pre class="language-py">x = 1\ny</pre><ol><li>a</li><li><a href="/u">b</a></li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>1|2</td><td>$5</td></tr></table><h2>Second</h2>loose text<img src="/j.png"><p>call 555-123-4567, 4/5</p><h2>Third</h2></body></html>"""


def _rich(spark):
    return spark.createDataFrame([(1, "https://x.org/d/p#f", _RICH)], "page_id long, url string, html string")


@query("SELECT * FROM (VALUES (0, NULL, 0, -1, 'paragraph', 'by Ann Lee', NULL, 'i', 'c d'), (1, NULL, 0, 1, 'heading', 'A _b_', '1', NULL, NULL), (2, NULL, 0, 1, 'group', NULL, 'div', NULL, NULL), (3, 2, 1, 1, 'group', NULL, 'section', NULL, NULL), (4, 3, 2, 1, 'heading', 'in', '2', NULL, NULL), (5, 3, 2, 1, 'image', 'x', 'i.png', NULL, NULL), (6, 2, 1, 1, 'link', 'go', '/l', NULL, NULL), (7, NULL, 0, 1, 'blockquote', 'q \\*r\\*', NULL, NULL, NULL), (8, NULL, 0, 1, 'code', 'x = 1' || chr(10) || 'y', 'py', NULL, 'language-py'), (9, NULL, 0, 1, 'list', 'a|b(https://x.org/u)', 'true', NULL, NULL), (10, NULL, 0, 1, 'table', 'h|k;1|2|$5', NULL, NULL, NULL), (11, NULL, 0, 11, 'heading', 'Second', '2', NULL, NULL), (12, NULL, 0, 11, 'paragraph', 'loose text', NULL, NULL, NULL), (13, NULL, 0, 11, 'image', '', '/j.png', NULL, NULL), (14, NULL, 0, 11, 'paragraph', 'call 555-123-4567, 4/5', NULL, NULL, NULL), (15, NULL, 0, 15, 'heading', 'Third', '2', NULL, NULL)) AS t(ord, parent_ord, depth, section_ord, type, said, detail, html_id, html_class)".replace("\\\\", "\\"))
def block_forms(spark, sf_dir):
    """Every kind of block, nested groups, sections and the page's own ids and classes."""
    items = F.array_join(F.transform("items", lambda i: F.concat(i["text"], F.coalesce(F.concat(F.lit("("), i["href"], F.lit(")")), F.lit("")))), "|")
    table = F.array_join(F.concat(F.array(F.array_join("headers", "|")), F.transform("rows", lambda r: F.array_join(r, "|"))), ";")
    said = F.coalesce("text", "code", "alt", F.when(F.col("type") == "list", items), F.when(F.col("type") == "table", table))
    detail = F.coalesce(F.col("level").cast("string"), "tag_name", "src", "href", "language", F.col("ordered").cast("string"))
    return page_blocks(with_fetch_columns(_rich(spark))).select("ord", "parent_ord", "depth", "section_ord", "type", said.alias("said"), detail.alias("detail"), "html_id", "html_class")


@query("SELECT * FROM (VALUES (0, 'by Ann Lee', 'author', 0.9::DOUBLE), (1, 'A _b_', 'heading', 1), (4, 'in', 'heading', 1), (5, 'x', 'image', 1), (6, 'go', 'link', 0.9), (7, 'q \\*r\\*', 'paragraph', 0.5), (8, 'x = 1' || chr(10) || 'y', 'code', 1), (9, 'a b', 'list', 0.8), (10, 'h k 1|2 $5', 'pricing', 0.7), (11, 'Second', 'heading', 1), (12, 'loose text', 'paragraph', 0.5), (14, 'call 555-123-4567, 4/5', 'rating', 0.75), (15, 'Third', 'heading', 1)) AS t(ord, said, classification, confidence)".replace("\\\\", "\\"))
def classify_forms(spark, sf_dir):
    """The label of every kind of block, in the page's own row; blank ones have none."""
    rows = metadata(parse_pages(with_fetch_columns(_rich(spark)), want=("facts", "linked", "blocks")), "linked", "blocks")
    rows = rows.withColumn("blocks", C.classified(F.col("blocks"), C.linked_hints(F.col("linked")), F.col("author"), F.col("published_time")))
    blocks = exploded(rows).filter("classification IS NOT NULL")
    return blocks.select("ord", C.block_text().alias("said"), "classification", "confidence")


_BODIES = "SELECT * FROM (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in RICH_BODIES.items()) + ") AS t(form, body)"


@query(_BODIES)
def read_forms(spark, sf_dir):
    """The rich page in every format, and as marked markdown."""
    marked = ReadOptions(marker=("pricing", "rating", "author"), frontmatter=False)
    every = read_pages(_rich(spark), marked).select(F.lit("marked").alias("form"), "body")
    for f in ("markdown", "json", "html", "text", "toon", "graph"):
        every = every.unionByName(read_pages(_rich(spark), ReadOptions(format=f, classify=True)).select(F.col("format").alias("form"), "body"))
    return every


@query("SELECT * FROM (VALUES ('added', 2), ('removed', 1), ('unchanged', 10)) AS t(change, n)")
def snapshot_diff_forms(spark, sf_dir):
    """The rich page against its stored snapshot, after an edit and an added paragraph."""
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    kept = D.snapshots(flattened(page_blocks(with_fetch_columns(_rich(spark)))), at("01"))
    edited = _RICH.replace("loose text", "other text<p>more</p>")
    now = flattened(page_blocks(with_fetch_columns(spark.createDataFrame([(1, "https://x.org/d/p#f", edited)], "page_id long, url string, html string"))))
    found = D.changes(D.stored_blocks(D.live_snapshots(kept, at("20"))), D.keyed(now))
    return found.groupBy("change").agg(F.count("*").cast("int").alias("n"))
