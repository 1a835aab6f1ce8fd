"""Queries over pages, files and records that Spark makes from rows of the given tables (see made_pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh import made_results as R
from quillmesh.functions import text as T
from quillmesh.functions import urls as U
from quillmesh.made_pages import PRODUCT, VALUES, filled_sql, made, made_rows, product_pages, quoted, rows_sql
from quillmesh.operators import classify as C
from quillmesh.operators import diff as D
from quillmesh.operators import discovery as N
from quillmesh.operators import graph as K
from quillmesh.operators import linking as L
from quillmesh.operators.markdown_blocks import markdown_blocks
from quillmesh.operators.metadata import metadata, record
from quillmesh.operators.sections import flattened
from quillmesh.plans.options import ReadOptions
from quillmesh.plans.read import read_pages
from quillmesh.sources.pages import exploded, jsonld_nodes, page_blocks, parse_pages, reconstructed, with_fetch_columns

QUERIES: dict = {}
ORACLES: dict = {}
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((xor(h, c)) * 16777619) & 4294967295)"


def query(sql: str):
    """Registers a query under its name, with the SQL of its result."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def _said(column: str, template: str, table: str = "part", key: str = "page_id") -> str:
    return f"SELECT {VALUES[table][0]} AS {key}, {filled_sql(quoted(template), table)} AS {column} FROM {table}"


# -- product pages: metadata and linked data -----------------------------------------------------------
_META = [("@N @K", "Item @K", "https://x.org/i/@K.png", "https://x.org/t.png", "https://x.org/c/@K", "Ann Lee", "2024-05-06", "/j/@K.png", " @N @K ", "p@S", "Hugo,Tailwind CSS")]
_META_NAMES = "title description image favicon canonical author published_time og_image og_title twitter_card frameworks"


@query(rows_sql("part", _META_NAMES, _META, "page_id"))
def part_metadata(spark, sf_dir):
    """First matches, property before name, the last of repeated og and twitter values, resolved addresses, frameworks."""
    m = metadata(parse_pages(with_fetch_columns(product_pages(spark, sf_dir)), want=("facts",)))
    maps = F.col("og")["image"].alias("og_image"), F.col("og")["title"].alias("og_title"), F.col("twitter")["card"].alias("twitter_card"), F.array_join("frameworks", ",").alias("frameworks")
    return m.select("page_id", "title", "description", "image", "favicon", "canonical", "author", "published_time", *maps)


@query(_said("record", R.RECORD))
def part_record(spark, sf_dir):
    """The sparse record as JSON: empty values left out, scripts that are no JSON passed over."""
    return metadata(parse_pages(with_fetch_columns(product_pages(spark, sf_dir)), want=("facts",))).select("page_id", record().alias("record"))


@query(rows_sql("part", "node_ord id type", [(0, "#o", "Organization"), (1, "#p@K", "schema:Product")], "page_id"))
def part_linked_nodes(spark, sf_dir):
    return jsonld_nodes(parse_pages(with_fetch_columns(product_pages(spark, sf_dir)), want=("linked",))).select("page_id", "node_ord", "id", F.element_at("types", 1).alias("type"))


@query(_said("main_id", "#o"))
def part_main_entity(spark, sf_dir):
    return parse_pages(with_fetch_columns(product_pages(spark, sf_dir)), want=("linked",)).select("page_id", K.main_id(F.col("linked")).alias("main_id"))


# -- product pages: blocks, labels and reads -----------------------------------------------------------
_BLOCKS = [
    (0, "-", 0, -1, "paragraph", "by Ann Lee", "-", "i@K", "c d"), (1, "-", 0, 1, "heading", "@N _@K_", "1", "-", "-"), (2, "-", 0, 1, "group", "-", "div", "-", "-"), (3, "2", 1, 1, "group", "-", "section", "-", "-"),
    (4, "3", 2, 1, "heading", "in @K", "2", "-", "-"), (5, "3", 2, 1, "image", "x", "@K.png", "-", "-"), (6, "2", 1, 1, "link", "go", "/l/@K", "-", "-"), (7, "-", 0, 1, "blockquote", "q \\*@K\\*", "-", "-", "-"),
    (8, "-", 0, 1, "code", "x = @K\ny", "py", "-", "language-py"), (9, "-", 0, 1, "list", "a @K|b(https://x.org/u/@K)", "true", "-", "-"), (10, "-", 0, 1, "table", "h|k;1|@K|$@S", "-", "-", "-"),
    (11, "-", 0, 11, "heading", "Second", "2", "-", "-"), (12, "-", 0, 11, "paragraph", "loose @N", "-", "-", "-"), (13, "-", 0, 11, "image", "", "/j@K.png", "-", "-"),
    (14, "-", 0, 11, "paragraph", "call 555-123-4567, 4/5", "-", "-", "-"), (15, "-", 0, 15, "heading", "Third @K", "2", "-", "-"),
]


@query(rows_sql("part", "ord parent depth section_ord type said detail html_id html_class", _BLOCKS, "page_id"))
def part_blocks(spark, sf_dir):
    """Every kind of block, nested groups, sections and the page's own ids and classes."""
    items = F.array_join(F.transform("items", lambda i: F.concat(i["text"], F.coalesce(F.concat(F.lit("("), i["href"], F.lit(")")), F.lit("")))), "|")
    table = F.array_join(F.concat(F.array(F.array_join("headers", "|")), F.transform("rows", lambda r: F.array_join(r, "|"))), ";")
    said = F.coalesce("text", "code", "alt", F.when(F.col("type") == "list", items), F.when(F.col("type") == "table", table), F.lit("-"))
    detail = F.coalesce(F.col("level").cast("string"), "tag_name", "src", "href", "language", F.col("ordered").cast("string"), F.lit("-"))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    blocks = page_blocks(with_fetch_columns(product_pages(spark, sf_dir)))
    return blocks.select("page_id", "ord", none("parent_ord").alias("parent"), "depth", "section_ord", "type", said.alias("said"), detail.alias("detail"), none("html_id").alias("html_id"), none("html_class").alias("html_class"))


_LABELS = [
    (0, "by Ann Lee", "author", 0.9), (1, "@N _@K_", "product", 0.95), (4, "in @K", "heading", 1.0), (5, "x", "image", 1.0), (6, "go", "link", 0.9), (7, "q \\*@K\\*", "paragraph", 0.5), (8, "x = @K\ny", "code", 1.0),
    (9, "a @K b", "list", 0.8), (10, "h k 1|@K $@S", "pricing", 0.7), (11, "Second", "heading", 1.0), (12, "loose @N", "product", 0.95), (14, "call 555-123-4567, 4/5", "rating", 0.75), (15, "Third @K", "heading", 1.0), (16, "@N by Ann Lee on 2024-05-06", "date", 0.9),
]


@query(rows_sql("part", "ord said classification confidence", _LABELS, "page_id"))
def part_labels(spark, sf_dir):
    """The label of every kind of block: rules, then what linked data names, then the author and the time."""
    html = PRODUCT.replace("</body>", "<p>@N by Ann Lee on 2024-05-06</p></body>")
    rows = metadata(parse_pages(with_fetch_columns(product_pages(spark, sf_dir, html)), want=("facts", "linked", "blocks")), "linked", "blocks")
    rows = rows.withColumn("blocks", C.classified(F.col("blocks"), C.linked_hints(F.col("linked")), F.col("author"), F.col("published_time")))
    return exploded(rows).filter("classification IS NOT NULL").select("page_id", "ord", C.block_text().alias("said"), "classification", F.col("confidence").cast("decimal(3,2)").cast("double").alias("confidence"))


@query(_said("classification", "date"))
def part_time_beats_author(spark, sf_dir):
    """A block that holds the publication time is a date, though it names the author and linked data too."""
    html = PRODUCT.replace("<p>call 555-123-4567, 4/5</p>", '<p id="t">@N by Ann Lee on 2024-05-06</p>')
    rows = metadata(parse_pages(with_fetch_columns(product_pages(spark, sf_dir, html)), want=("facts", "linked", "blocks")), "linked", "blocks").withColumn("hints", C.linked_hints(F.col("linked")))
    return C.classify(exploded(rows, "hints", "author", "published_time")).filter("html_id = 't'").select("page_id", "classification")


def _read(form: str, **more):
    def run(spark, sf_dir):
        return read_pages(product_pages(spark, sf_dir), ReadOptions(format=form, **more)).select("page_id", "body")

    return run


def _read_query(name: str, template: str, form: str, **more) -> None:
    QUERIES[name], ORACLES[name] = _read(form, **more), _said("body", template)


_read_query("part_markdown", R.MARKDOWN, "markdown", classify=True)
_read_query("part_json", '{"metadata":' + R.RECORD + ',"content":' + R.CONTENT + "}", "json", classify=True)
_read_query("part_html", PRODUCT[PRODUCT.index('bg-red-5">') + 10 : PRODUCT.index("</body>")], "html")
_read_query("part_text", R.TEXT, "text")
_read_query("part_toon", R.TOON, "toon", classify=True)


def _hashed(template: str, texts: tuple[str, ...]) -> str:
    """SQL of a template in which @1, @2 and so on are hashes of texts that are templates, too."""
    hashes = ", ".join(f"printf('%08x', {_FNV.format(filled_sql(quoted(t), 'part'))}) AS h{i}" for i, t in enumerate(texts, 1))
    said = filled_sql(quoted(template), "part")
    for i in range(1, len(texts) + 1):
        said = f"replace({said}, '@{i}', h{i})"
    return f"SELECT p_partkey AS page_id, {said} AS body FROM (SELECT *, {hashes} FROM part)"


QUERIES["part_marked"], ORACLES["part_marked"] = _read("markdown", marker=("pricing", "rating", "author"), frontmatter=False), _hashed(R.MARKED, R.MARKED_HASHED)


@query(_hashed(R.GRAPH, R.HASHED))
def part_graph(spark, sf_dir):
    """Nodes of the page, its sections and blocks, of linked data and of the author."""
    return read_pages(product_pages(spark, sf_dir), ReadOptions(format="graph", classify=True)).select("page_id", "body")


@query(rows_sql("part", "change n", [("added", 2), ("removed", 1), ("unchanged", 10)], "page_id"))
def part_snapshot_changes(spark, sf_dir):
    """Pages against their stored snapshots, after an edit and an added paragraph."""
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    kept = D.snapshots(flattened(page_blocks(with_fetch_columns(product_pages(spark, sf_dir)))), at("01"))
    now = flattened(page_blocks(with_fetch_columns(product_pages(spark, sf_dir, PRODUCT.replace("loose @N", "other @N<p>more @K</p>")))))
    found = D.changes(D.stored_blocks(D.live_snapshots(kept, at("20"))), D.keyed(now))
    key = F.regexp_extract("url", r"/d/(\d+)#", 1).cast("long")
    return found.groupBy(key.alias("page_id"), "change").agg(F.count("*").alias("n"))


# -- addresses and text -------------------------------------------------------------------------------
_FORMS = [("Example.COM/@K", "https://example.com/@K"), ("http:/x@K.org", "http://x@K.org/"), ("HTTP://X@K.org:80/%7Ea/../b?q=a b#f", "http://x@K.org/b?q=a%20b#f"), ("https://x.org:8@S/./", "https://x.org:8@S/"), (" http://x.org/@K ", "http://x.org/@K")]


@query(rows_sql("customer", "raw url", _FORMS))
def customer_url_forms(spark, sf_dir):
    """Addresses with blanks, without a scheme, with a broken one, default ports and dots."""
    return made_rows(spark, sf_dir, "customer", "raw url", _FORMS).select("k", "raw", U.normalize_url(F.col("raw")).alias("url"))


_HREFS = [
    ("a@K", "https://x.org/d/e?q", "https://x.org/d/a@K"), ("../a", "https://x.org/d@K/e/f", "https://x.org/d@K/a"), ("/r@K", "https://x.org/d", "https://x.org/r@K"), ("//y@K.org/z", "https://x.org/", "https://y@K.org/z"),
    ("?n=@K", "https://x.org/d/e?q", "https://x.org/d/e?n=@K"), ("#f@K", "https://x.org/d", "https://x.org/d#f@K"), ("mailto:a@b.c@K", "https://x.org/", "mailto:a@b.c@K"), ("http://", "https://x@K.org/", "http://"),
]


@query(rows_sql("customer", "href base url", _HREFS))
def customer_hrefs(spark, sf_dir):
    return made_rows(spark, sf_dir, "customer", "href base url", _HREFS).select("k", "href", "base", U.resolve_url(F.col("href"), F.col("base")).alias("url"))


_SPACED = [("<span>@K</span><span>b</span>", " @N \t\r\n\n\n\ny@K\n", "<span>@K</span> <span>b</span>", "@N\n\ny@K"), ("<h1>@K</h1>\n<h2>b</h2>", "p@K\r\nq", "<h1>@K</h1> <h2>>b</h2>", "p@K\nq"), ("<a>x</a><a>@K</a><b></b>", " \n ", "<a>x</a> <a>@K</a><b></b>", "")]


@query(rows_sql("part", "h t spaced collapsed", _SPACED))
def part_spacing(spark, sf_dir):
    rows = made_rows(spark, sf_dir, "part", "h t", [r[:2] for r in _SPACED])
    return rows.select("k", "h", "t", T.space_injection(F.col("h")).alias("spaced"), T.collapse_whitespace(F.col("t")).alias("collapsed"))


_MD = "# T @K\ntext @N\n- a@K\n* [b](u@K)\n1. c\n\n> q@K\n![i](s@K)\n[l](h@K)\n```py\nx = @K\n\ny\n```\n```\nlost"
_MD_ROWS = [(0, "heading", "T @K", "-"), (1, "paragraph", "text @N", "-"), (2, "list", "a@K|b", "-"), (3, "list", "c", "-"), (4, "blockquote", "q@K", "-"), (5, "image", "i", "s@K"), (6, "link", "l", "h@K"), (7, "code", "x = @K\n\ny", "py")]


@query(rows_sql("customer", "ord type said target", _MD_ROWS, "id"))
def customer_markdown_blocks(spark, sf_dir):
    blocks = markdown_blocks(made(spark, sf_dir, "customer", md=_MD), "k", "md")
    items = F.array_join(F.transform("items", lambda i: i["text"]), "|")
    return blocks.select("id", "ord", "type", F.coalesce("text", "code", "alt", items).alias("said"), F.coalesce("href", "src", "language", F.lit("-")).alias("target"))


_JSON = [
    ('{"x":[{"_type":"block","children":[{"text":"a@K "},{"text":"b","marks":["strong"]}]},{"_type":"block","style":"h2","children":[{"text":"@N"}]}]}', "html", "<p>a@K <strong>b</strong></p>\n<h2>@N</h2>\n"),
    ('{"body":"' + "word@K " * 12 + '","z":"' + "long " * 30 + '"}', "text", "<p>" + "word@K " * 12 + "</p>"), ("{bad@K", "-", "-"),
]


@query(rows_sql("part", "j kind html", _JSON))
def part_reconstructed(spark, sf_dir):
    """The best text of JSON: rich text rendered, a well-known key before a longer value, none of what is no JSON."""
    out = reconstructed(made_rows(spark, sf_dir, "part", "j", [r[:1] for r in _JSON]), "j")
    return out.select("k", "j", F.coalesce("best.kind", F.lit("-")).alias("kind"), F.coalesce("best.html", F.lit("-")).alias("html"))


# -- robots and sitemaps: a site for each customer, its orders as pages --------------------------------
_ROBOTS = "# c\nUser-agent: a@K\nUser-agent: b # x\nAllow: /p@K\nDisallow:\nDisallow: /q\nCrawl-delay: @S.5\nSitemap: https://x@K.org/s.xml\nsitemap: https://x@K.org/s.xml\nHost: x@K.org"


def _robots(spark, sf_dir) -> DataFrame:
    return made(spark, sf_dir, "customer", origin="https://x@K.org", body=_ROBOTS).drop("k")


@query("SELECT 'https://x' || c_custkey || '.org' AS origin, rule, CASE rule WHEN 1 THEN 'a' || c_custkey ELSE 'b' END AS agent, CASE rule WHEN 1 THEN '' ELSE '/p' || c_custkey END AS allow, CASE rule WHEN 1 THEN '' ELSE '/q' END AS disallow, CASE rule WHEN 2 THEN c_nationkey + 0.5::DOUBLE END AS crawl_delay FROM customer, (VALUES (1), (2)) AS t(rule)")
def customer_robots_rules(spark, sf_dir):
    return N.robots_rules(_robots(spark, sf_dir)).select("origin", F.col("rule").cast("int").alias("rule"), "agent", F.array_join("allow", ",").alias("allow"), F.array_join("disallow", ",").alias("disallow"), "crawl_delay")


@query(rows_sql("customer", "sitemaps host hint", [("https://x@K.org/s.xml", "x@K.org", "https://x@K.org/s.xml")]).replace("c_custkey AS k, ", ""))
def customer_robots_sites(spark, sf_dir):
    robots = _robots(spark, sf_dir)
    return N.robots_sites(robots).join(robots, "origin").select(F.array_join("sitemaps", ",").alias("sitemaps"), "host", N.sitemap_hint(F.col("body")).alias("hint"))


def _site_files(spark, sf_dir) -> DataFrame:
    """A site's index of two sitemaps: one of all its customer's orders, one that is a plain list; others that are missing or no sitemap."""
    files = [
        ("https://x@K.org/s.xml", 200, "application/xml", "<sitemapindex><sitemap><loc> https://x@K.org/1.xml </loc></sitemap><sitemap><loc>/2.xml</loc></sitemap></sitemapindex>"), ("https://x@K.org/2.xml", 200, "text/xml", "<loc>https://x@K.org/b</loc>"),
        ("https://x@K.org/sitemap.xml", 404, "text/html", "no"), ("https://x@K.org/sitemap.txt", 200, "text/plain", "https://x@K.org/t"),
    ]
    fixed = made_rows(spark, sf_dir, "customer", "url status content_type body", files).drop("k", "n")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    loc = F.transform("x", lambda o: F.concat(F.lit("<url><loc>https://x.org/o/"), o.cast("string"), F.lit("</loc></url>")))
    listed = orders.select(F.concat(F.lit("https://x"), F.col("o_custkey").cast("string"), F.lit(".org/1.xml")).alias("url"), F.lit(200).alias("status"), F.lit("text/xml").alias("content_type"), F.concat(F.lit("<urlset>"), F.array_join(loc, ""), F.lit("</urlset>")).alias("body"))
    return fixed.unionByName(listed).withColumn("location", F.lit(None).cast("string"))


_ORDERS = "(SELECT o_custkey, string_agg('https://x.org/o/' || o_orderkey, ',' ORDER BY o_orderkey) AS urls FROM orders GROUP BY o_custkey)"
_FILES = "(VALUES ('/s.xml', 'index'), ('/2.xml', 'urlset'), ('/sitemap.xml', 'unknown'), ('/sitemap.txt', 'unknown')) AS t(path, kind)"


@query(f"SELECT 'https://x' || c_custkey || '.org' || path AS url, kind, CASE path WHEN '/2.xml' THEN 'https://x' || c_custkey || '.org/b' ELSE '' END AS urls, CASE path WHEN '/s.xml' THEN 'https://x' || c_custkey || '.org/1.xml,/2.xml' ELSE '' END AS sitemaps FROM customer, {_FILES} UNION ALL SELECT 'https://x' || o_custkey || '.org/1.xml', 'urlset', urls, '' FROM {_ORDERS}")
def customer_sitemaps(spark, sf_dir):
    x = N.parsed_sitemap(F.col("body"))
    return _site_files(spark, sf_dir).select("url", x["kind"].alias("kind"), F.array_join(x["urls"], ",").alias("urls"), F.array_join(x["sitemaps"], ",").alias("sitemaps"))


def _best(spark, sf_dir) -> DataFrame:
    sites = made(spark, sf_dir, "customer", origin="https://x@K.org").select("origin")
    return N.best_sitemaps(N.sitemap_candidates(sites, _robots(spark, sf_dir)), _site_files(spark, sf_dir))


@query("SELECT 'https://x' || c_custkey || '.org' AS origin, 'https://x' || c_custkey || '.org/s.xml' AS sitemap_url, 'index' AS kind FROM customer")
def customer_best_sitemaps(spark, sf_dir):
    return _best(spark, sf_dir).select("origin", "sitemap_url", F.col("sitemap.kind").alias("kind"))


@query(f"SELECT 'https://x' || c_custkey || '.org' AS origin, 1 AS pos, 'https://x' || c_custkey || '.org/2.xml' AS child_url, 'https://x' || c_custkey || '.org/b' AS urls FROM customer UNION ALL SELECT 'https://x' || o_custkey || '.org', 0, 'https://x' || o_custkey || '.org/1.xml', urls FROM {_ORDERS} SEMI JOIN customer ON c_custkey = o_custkey")
def customer_sitemap_pages(spark, sf_dir):
    return N.expand_indexes(_best(spark, sf_dir), _site_files(spark, sf_dir)).select("origin", "pos", "child_url", F.array_join("urls", ",").alias("urls"))


# -- entity linking: a page for each supplier, a knowledge base of the same rows ------------------------
_NODES = [("#a", "Person", " Ada @K ", None, None), ("#b", "WebPageElement", None, "Berlin @K", None), ("#c", "Table", "No", None, None), ("#d", "http://schema.org/Place", "Rome", None, "https://www.wikidata.org/wiki/Q22@K"), ("#e", None, "Unknown @K", None, None)]
_KB = [("Ada @K", 1, "Q1@K", "Ada @K Lovelace", "alias"), ("Ada @K", 2, "Q2@K", "Ada @K", "label"), ("Berlin @K", 1, "Q64@K", "Berlin", "alias"), ("Unknown @K", 1, "Q9@K", "Other", "alias")]


def _nodes(spark, sf_dir) -> DataFrame:
    rows = made_rows(spark, sf_dir, "supplier", "id type name headline same", _NODES)
    none = F.lit(None).cast("string")
    many = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    return rows.select(F.col("k").alias("page_id"), F.col("n").alias("node_ord"), "id", many("type").alias("types"), "name", "headline", none.alias("pref_label"), none.alias("rdf_label"), none.alias("text"), F.when(F.col("same").isNotNull(), F.array("same")).alias("same_as"))


def _linked(spark, sf_dir) -> DataFrame:
    found = made_rows(spark, sf_dir, "supplier", "search_label rank qid label match_type", _KB).drop("k", "n")
    return L.resolve(L.candidates(_nodes(spark, sf_dir)), found)


@query(rows_sql("supplier", "id label existing_qid", [("#a", "Ada @K", "-"), ("#b", "Berlin @K", "-"), ("#d", "Rome", "Q22@K"), ("#e", "Unknown @K", "-")], "page_id"))
def supplier_link_candidates(spark, sf_dir):
    return L.candidates(_nodes(spark, sf_dir)).select("page_id", "id", "label", F.coalesce("existing_qid", F.lit("-")).alias("existing_qid"))


@query(rows_sql("supplier", "id qid label confidence", [("#a", "Q1@K", "Ada @K Lovelace", "exact"), ("#b", "Q64@K", "Berlin", "exact"), ("#d", "Q22@K", "-", "exact")], "page_id"))
def supplier_entity_links(spark, sf_dir):
    return _linked(spark, sf_dir).select("page_id", "id", "qid", F.coalesce("label", F.lit("-")).alias("label"), "confidence")


@query(rows_sql("supplier", "id name same_as", [("#a", "Ada @K", "http://www.wikidata.org/entity/Q1@K"), ("#b", "Berlin", "http://www.wikidata.org/entity/Q64@K"), ("#c", "No", "-"), ("#d", "Rome", "https://www.wikidata.org/wiki/Q22@K,http://www.wikidata.org/entity/Q22@K"), ("#e", "Unknown @K", "-")], "page_id"))
def supplier_linked_nodes(spark, sf_dir):
    out = L.attach(_nodes(spark, sf_dir), _linked(spark, sf_dir))
    return out.select("page_id", "id", F.trim("name").alias("name"), F.coalesce(F.array_join("same_as", ","), F.lit("-")).alias("same_as"))


@query(rows_sql("supplier", "id label definition claims", [("http://www.wikidata.org/entity/Q64@K", "Berlin", "city @K", "wdt:P31=http://www.wikidata.org/entity/Q515;wdt:P569=1237-01-01,1307-01-01;wdt:P856=https://berlin@K.de")]).replace("s_suppkey AS k, ", ""))
def supplier_entities(spark, sf_dir):
    """Knowledge-base entries of linked entities as nodes: labels, definitions and decoded values."""
    base = made(spark, sf_dir, "supplier", qid="Q64@K", about="city @K", home='"https://berlin@K.de"')
    claim = lambda prop, rank, kind, value: F.struct(F.lit(prop).alias("property"), F.lit(rank).alias("rank"), F.lit(kind).alias("type"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    claims = F.array(claim("P856", 0, "string", F.col("home")), claim("P31", 0, "wikibase-entityid", '{"id":"Q515"}'), claim("P569", 0, "time", '{"time":"+1237-01-01T00:00:00Z"}'), claim("P569", 1, "time", '{"time":"+1307-01-01T00:00:00Z"}'), claim("P625", 0, "globecoordinate", "{}"))
    kb = base.select("qid", F.create_map(F.lit("de"), F.lit("Berlin")).alias("labels"), F.create_map(F.lit("en"), F.col("about")).alias("descriptions"), claims.alias("claims"))
    told = F.array_join(F.transform("claims", lambda c: F.concat(c["prop"], F.lit("="), F.array_join(c["values"], ","))), ";")
    return L.entity_nodes(_linked(spark, sf_dir), kb).select("id", "label", "definition", told.alias("claims"))


# -- changes of blocks that are keyed by less than their content ---------------------------------------
@query(rows_sql("customer", "change said", [("added", "new @K"), ("changed", "-"), ("removed", "old @K"), ("unchanged", "same @K")], "url").replace("c_custkey AS url", "CAST(c_custkey AS VARCHAR) AS url"))
def customer_block_changes(spark, sf_dir):
    """An edited text is removed and added; a list whose links alone differ is changed."""
    names = "type string, code string, src string, alt string, ordered boolean, headers array<string>, rows array<array<string>>, html_id string, html_class string, href string"

    def side(*blocks):
        rows = made_rows(spark, sf_dir, "customer", "type text link", list(blocks))
        items = F.when(F.col("link").isNotNull(), F.array(F.struct(F.lit("x").alias("text"), F.col("link").alias("href"))))
        blank = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in names.split(", ")) if c not in ("type", "ordered")]
        return D.keyed(rows.select(F.col("k").cast("string").alias("url"), F.col("n").alias("ord"), "type", "text", F.lit(False).alias("ordered"), items.alias("items"), *blank))

    before = side(("paragraph", "same @K", None), ("paragraph", "old @K", None), ("list", None, "/1"))
    after = side(("paragraph", "new @K", None), ("list", None, "/2@K"), ("paragraph", "same @K", None))
    said = F.when(F.col("change") != "changed", F.coalesce("after", "before"))
    return D.changes(before, after).select("url", "change", F.coalesce(said, F.lit("-")).alias("said"))
