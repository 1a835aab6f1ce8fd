"""The parse stage on golden pages: soup, blocks, markdown, hydration, bad input."""

import json
import random

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from quillmesh.functions.hashing import fnv1a_text
from quillmesh.functions.text import EDGE
from quillmesh.functions.urls import canonical, normalized, resolve
from quillmesh.plans.options import DiffOptions, GraphOptions, OptionError, ReadOptions, flag, parse_options, split_request
from quillmesh.plans.crawl import parse_robots, parse_sitemaps
from quillmesh.plans.cache import cached_reads, upsert_cache
from quillmesh.plans.diff import diff_pages, diff_stored, track_pages
from quillmesh.plans.graph import build_graph
from quillmesh.operators.graph import graph_pairs
from quillmesh.plans import read as R
from quillmesh.plans.read import content_rows, described, info, read_pages
from quillmesh.plans.toon import toon
from quillmesh.sources.blocks import block_rows
from quillmesh.sources.emit import Style, markdown
from quillmesh.made_pages import PRODUCT
from quillmesh.operators import classify as C
from quillmesh.operators import metadata as M
from quillmesh.sources import html as H
from quillmesh.sources import pages as P
from quillmesh.sources.html import parse_html, prune, select_first
from quillmesh.sources.pages import ParseOptions, page_blocks, page_facts, parse_pages, with_fetch_columns
from quillmesh.sources.reconstruct import reconstruct, score_text, sentences


def body(html):
    root = parse_html(html)
    prune(root)
    return next(n for n in root.children if n.tag == "body")


def blocks(html):
    return block_rows(body(html), Style("https://x.org/d/"))


def test_soup_closes_paragraphs_and_ignores_strays():
    out = blocks('<p><b>one<br><p>two</i><script>var t="</p>"</script><p>three')
    assert [b["text"] for b in out] == ["**one**", "two", "three"]


@pytest.mark.parametrize(
    ("html", "kind", "fields"),
    [
        ("<h2>a <em>b</em></h2>", "heading", {"level": 2, "text": "a _b_"}),
        ('<p><img src="i.png" alt="x"></p>', "image", {"src": "i.png", "alt": "x"}),
        ('<p><a href="/l">go</a></p>', "link", {"href": "/l", "text": "go"}),
        ("<blockquote>q</blockquote>", "blockquote", {"text": "q"}),
        ('<pre class="language-py">x = 1\n</pre>', "code", {"language": "py", "code": "x = 1"}),
        ('<ol><li>a<ul><li>n</li></ul></li><li><a href="/u">b</a></li></ol>', "list", {"ordered": True}),
        ("<table><tr><th>h</th></tr><tr><td>1</td></tr></table>", "table", {"headers": ["h"], "rows": [["1"]]}),
        ("<table><tr><td>1</td></tr></table>", "table", {"headers": [], "rows": [["1"]]}),
        ('<span id="i" class="c">t</span>', "paragraph", {"text": "t", "html_id": "i", "html_class": "c"}),
    ],
)
def test_block_types(html, kind, fields):
    (out,) = blocks(html)
    assert out["type"] == kind
    assert {k: out.get(k) for k in fields} == fields


def test_list_items_belong_to_their_own_list():
    (out,) = blocks('<ol><li>a<ul><li>n</li></ul></li><li><a href="/u">b</a></li></ol>')
    assert out["items"][1] == {"text": "b", "href": "https://x.org/u"}
    assert len(out["items"]) == 2


def test_groups_nest_by_parent():
    out = blocks("<div><section><p>a</p></section><p>b</p></div><div> </div>")
    assert [(b["type"], b["parent_ord"], b["depth"]) for b in out] == [("group", None, 0), ("group", 0, 1), ("paragraph", 1, 2), ("paragraph", 0, 1)]


def test_markdown_forms():
    html = '<h1>T</h1><p>a <strong>b</strong> <code>c</code> <a href="u" title="t">l</a></p><ul><li>x</li><li>y</li></ul><hr><table><tr><td>p|q</td></tr><tr><td>r</td><td>s</td></tr></table><pre><code class="language-js">let a\n</code></pre>'
    assert markdown(body(html), Style("https://x.org/")) == '# T\n\na **b** `c` [l](https://x.org/u "t")\n\n-   x\n-   y\n\n---\n\n| p\\|q |  |\n| --- | --- |\n| r | s |\n\n```js\nlet a\n```'
    assert markdown(body('<p><a href="u">l</a><img src="i" alt="x"></p>'), Style(links="discard", images="alt-only")) == "lx"


def test_selectors():
    root = parse_html('<div id="a"><p class="x y" data-k="v">1</p><p>2</p></div>')
    for s in ("#a .y", "div > p.x", "p[data-k=v]", "p[data-k^='v']", "nope, p"):
        assert select_first(root, s).text() == "1"
    assert select_first(root, "p:not(.x)").text() == "2"
    assert select_first(root, "section") is None


def test_urls():
    assert canonical("HTTPS://X.org:443/a/./b/../c?d e") == "https://x.org/a/c?d%20e"
    assert normalized("x.org") == "https://x.org/"
    assert normalized("http://[bad host/") is None
    assert resolve("é", "https://x.org/") == "https://x.org/%C3%A9"
    assert resolve("a", "not a url") is None


def test_fnv():
    assert [fnv1a_text(t) for t in ("", "a", "\N{GRINNING FACE}")] == ["811c9dc5", "e40c292c", fnv1a_text("\N{GRINNING FACE}")]


def test_scores_and_reconstruction():
    assert score_text("x" * 49) == ("text", 0)
    assert score_text("<p>a</p>" * 8)[0] == "html"
    assert score_text("# head\n" + "word " * 12)[0] == "markdown"
    editor = {"blocks": [{"type": "header", "data": {"text": "T", "level": 3}}, {"type": "list", "data": {"style": "ordered", "items": ["a", 1]}}]}
    assert reconstruct(editor)["html"] == "<h3>T</h3>\n<ol>\n  <li>a</li>\n</ol>\n"
    assert reconstruct({"a": 1}) is None
    assert sentences({"a": ["this is a sentence of prose", "http://not this one here at all", "const x = 1 and so on and on"]}) == ["this is a sentence of prose"]


def test_toon():
    assert toon({"a": [{"x": 1, "y": "p,q"}, {"x": 2, "y": "r"}], "b": [1, True, None], "c": {"d": ""}}) == 'a[2]{x,y}:\n  1,"p,q"\n  2,r\nb[3]: 1,true,null\nc:\n  d: ""'
    assert toon({"a": [{"x": 1}, {"y": [1]}]}) == "a[2]:\n  - x: 1\n  - y[1]: 1"


def test_options():
    o = parse_options(ReadOptions, {"marker": " Date,link,nope", "frontmatter": "0"}, {"format": "json", "timeout": "2000"})
    assert (o.marker, o.frontmatter, o.format, o.timeout) == (("date", "link"), False, "json", 2000)
    assert parse_options(DiffOptions, {"update": ""}).update is True
    for bad in (lambda: ReadOptions(timeout=1), lambda: ReadOptions(format="pdf"), lambda: GraphOptions(limit=16), lambda: flag("maybe")):
        with pytest.raises(OptionError):
            bad()
    assert split_request("x.org/p?format=json&q=1") == ("https://x.org/p?q=1", {"format": "json"})
    assert len(info()["markers"]) == 13


def pages(spark, *rows):
    return spark.createDataFrame([(k, f"https://x.org/{k}", h) for k, h in enumerate(rows)], "page_id long, url string, html string")


NEXT = '<script id="__NEXT_DATA__">' + json.dumps({"body": "<p>" + "word " * 40 + "</p><p>b</p><p>c</p>"}) + "</script>"


def test_hydration_and_bad_rows(spark):
    remix = "<script>window.__remixContext = " + json.dumps({"content": "plain text " * 20}) + ";</script>"
    astro = "<astro-island props='" + json.dumps({"text": "island text of words " * 6}) + "'></astro-island>"
    prose = '<script id="__NEXT_DATA__">{"a":"a short sentence of some prose"}</script>'
    rows = page_facts(with_fetch_columns(pages(spark, NEXT, remix, astro, prose, None, "<p>x"))).orderBy("page_id").collect()
    assert [r.engine for r in rows] == ["json-reconstructor"] * 4 + ["dom", "dom"]
    assert rows[3].text_content == "a short sentence of some prose"
    assert rows[4].text_content == ""


def test_reads(spark):
    html = '<html lang="en"><head><title>T</title></head><body><h1>A</h1><p>by Ann</p><div><h2>in</h2><p>$5</p></div></body></html>'
    p = pages(spark, html)
    got = {f: read_pages(p, ReadOptions(format=f, classify=True)).first() for f in ("markdown", "json", "html", "text", "toon", "raw")}
    assert got["raw"].body == html
    assert got["text"].engine == "dom"
    assert got["markdown"].body.startswith("---\nurl: https://x.org/0\nfinalUrl:")
    value = json.loads(got["json"].body)
    assert value["metadata"]["title"] == "T"
    (section,) = value["content"]
    assert section["heading"] == "A"
    assert section["content"][0] == {"type": "paragraph", "text": "by Ann", "classification": "author", "confidence": 0.6}
    assert section["content"][1]["children"][1]["classification"] == "pricing"
    assert got["toon"].body.startswith("metadata:\n  url: ")
    marked = read_pages(p, ReadOptions(marker=("pricing",), frontmatter=False)).first().body
    assert "<!-- QUILL:pricing:" in marked and "# A" not in marked and "## in" in marked


def test_fallbacks_and_content_types(spark):
    p = with_fetch_columns(pages(spark, "<p>tiny", "{}")).withColumn("content_type", __import__("pyspark").sql.functions.expr("if(page_id = 1, 'application/json', content_type)"))
    rendered = spark.createDataFrame([("https://x.org/0", "# rendered")], "url string, content string")
    rows = read_pages(p, ReadOptions(frontmatter=False), rendered=rendered).orderBy("page_id").collect()
    assert [(r.engine, r.body) for r in rows] == [("rendered", "# rendered\n"), ("raw", "{}")]
    assert page_blocks(p).select("page_id").distinct().count() == 1
    site = spark.createDataFrame([("https://x.org/page-data/0/page-data.json", 200, "application/json", None, json.dumps({"html": "<p>" + "w " * 60 + "</p><p>b</p><p>c</p>"}))], "url string, status int, content_type string, location string, body string")
    row = read_pages(pages(spark, '<div id="___gatsby"></div>'), ReadOptions(format="text"), resources=site).first()
    assert row.engine == "json-reconstructor" and row.body.startswith("w w")


def test_graph_and_linking(spark):
    html = '<html><head><title>Berlin</title><meta name="author" content="Ada"></head><body><h1>Berlin city</h1><p>text</p></body></html>'
    kb = spark.createDataFrame([("Berlin city", 1, "Q64", "Berlin", "label")], "search_label string, rank int, qid string, label string, match_type string")
    entities = spark.createDataFrame([("Q64", {"en": "Berlin"}, {}, [("P31", 0, "string", '"city"')])], "qid string, labels map<string,string>, descriptions map<string,string>, claims array<struct<property:string,rank:int,type:string,value:string>>")
    row = build_graph(pages(spark, html), GraphOptions(), kb, entities).first()
    doc = json.loads(row.document)
    ids = [n["@id"] for n in doc["@graph"]]
    assert ids[0] == "https://x.org/0#webpage" and ids[1].startswith("https://x.org/0#section-l1-")
    assert row.n_linked == 1
    assert doc["@graph"][1]["sameAs"] == "http://www.wikidata.org/entity/Q64"
    assert doc["@graph"][-1] == {"@id": "http://www.wikidata.org/entity/Q64", "rdfs:label": "Berlin", "skos:prefLabel": "Berlin", "wdt:P31": "city"}
    assert doc["@graph"][0]["hasPart"] == {"@list": [{"@id": ids[1]}]}


def test_diff_of_pages(spark):
    a, b = pages(spark, "<p>one</p><p>two</p>"), pages(spark, "<p>one</p><p>three</p>")
    text = diff_pages(a, b).first().body
    assert text.splitlines()[3] == "@@ +1 -1 ~0 (1 unchanged) @@"
    assert "+three" in text and "-two" in text
    assert diff_pages(a, a).first().body.endswith(" (no changes)\n")
    value = json.loads(diff_pages(a, b, DiffOptions(output="json")).first().body)
    assert value["summary"] == {"added": 1, "removed": 1, "changed": 0, "unchanged": 1}


def test_crawl(spark):
    res = spark.createDataFrame([("https://x.org/robots.txt", 200, "text/plain", None, "User-agent: *\nDisallow: /p\nSitemap: https://x.org/s.xml"), ("https://x.org/s.xml", 200, "text/xml", None, "<urlset><url><loc>https://x.org/a</loc></url></urlset>")], "url string, status int, content_type string, location string, body string")
    p = pages(spark, "a")
    row = parse_robots(p, res).first()
    assert row.rules[0].disallow == ["/p"] and row.sitemaps == ["https://x.org/s.xml"] and row.error is None
    row = parse_sitemaps(p, res).first()
    assert row.sitemap.urls == ["https://x.org/a"]
    none = spark.createDataFrame([], res.schema)
    assert parse_robots(p, none).first().error == "no robots.txt"
    assert parse_sitemaps(p, none).first().error == "no sitemap"


RES = "url string, status int, content_type string, location string, body string"


def test_equal_rows_and_rows_without_an_id_stay_rows(spark):
    rows = [(1, "https://x.org/1", "<h1>A</h1><p>text</p>")] * 3 + [(None, "https://x.org/2", "<p>other</p>"), (5, "https://x.org/5", None)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    res = spark.createDataFrame([("https://x.org/robots.txt", 200, "text/plain", None, "Sitemap: https://x.org/s.xml")] * 2, RES)
    for f in ("raw", "markdown", "json", "html", "text", "toon"):
        out = read_pages(p, ReadOptions(format=f), resources=res).collect()
        assert sorted(str(r.page_id) for r in out) == ["1", "1", "1", "5", "None"], f
        assert len({r.body for r in out if r.page_id == 1}) == 1
    assert "sitemap: https://x.org/s.xml" in read_pages(p, resources=res).filter("page_id = 1").first().body
    assert sorted(str(r.page_id) for r in build_graph(p).collect()) == ["1", "5", "None"]
    assert sorted(str(r.page_id) for r in read_pages(p, ReadOptions(format="graph")).collect()) == ["1", "1", "1", "5", "None"]


def test_content_from_elsewhere_shows_in_every_format(spark):
    p = pages(spark, '<div id="___gatsby"></div><title>Raw</title>', "<p>tiny")
    site = spark.createDataFrame([("https://x.org/page-data/0/page-data.json", 200, "application/json", None, json.dumps({"html": "<h1>Site</h1><p>" + "w " * 60 + "</p><p>b</p><p>c</p>"}))], RES)
    rendered = spark.createDataFrame([("https://x.org/1", "# Shown\n\ntext by Ann\n- a\n- b", "New title")], "url string, content string, title string")
    got = {f: {r.page_id: r for r in read_pages(p, ReadOptions(format=f, frontmatter=False, classify=True), resources=site, rendered=rendered).collect()} for f in ("markdown", "json", "html", "text", "toon", "graph")}
    assert {r[0].engine for f, r in got.items() if f != "graph"} == {"json-reconstructor"} and {r[1].engine for f, r in got.items() if f != "graph"} == {"rendered"}
    assert got["markdown"][0].body.startswith("# Site") and got["markdown"][1].body.startswith("# Shown")
    one, two = json.loads(got["json"][0].body), json.loads(got["json"][1].body)
    assert (one["metadata"]["title"], one["metadata"]["frameworks"]) == ("Raw", ["Gatsby"]) and "favicon" not in one["metadata"]
    assert one["content"][0]["heading"] == "Site"
    assert two["metadata"]["title"] == "New title"
    assert two["content"] == [{"heading": "Shown", "level": 1, "content": [{"type": "paragraph", "text": "text by Ann", "classification": "author", "confidence": 0.6}, {"type": "list", "ordered": False, "items": [{"text": "a"}, {"text": "b"}], "classification": "list", "confidence": 0.8}], "children": []}]
    assert got["html"][1].body == "<pre># Shown\n\ntext by Ann\n- a\n- b</pre>"
    assert got["toon"][1].body.startswith("metadata:")
    assert [n.get("name") for n in json.loads(got["graph"][0].body)["@graph"]][:2] == ["Raw", "Site"]


def test_images(spark):
    p = pages(spark, '<p>a <img src="/i.png" alt="x [y]"> b</p>')
    got = {k: read_pages(p, ReadOptions(frontmatter=False, images=k)).first().body for k in ("keep", "alt-only", "discard")}
    assert got == {"keep": "a ![x y](https://x.org/i.png) b\n", "alt-only": "a x [y] b\n", "discard": "a b\n"}
    with pytest.raises(OptionError):
        ReadOptions(images="inline")


def test_deep_pages_keep_their_content(spark):
    p = pages(spark, "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>after</p>")
    for f in ("markdown", "json", "html", "text"):
        row = read_pages(p, ReadOptions(format=f, frontmatter=False)).first()
        assert row.error is None and "deep" in row.body and "after" in row.body


def test_linked_nodes_have_each_property_once(spark):
    html = '<html><head><script type="application/ld+json">{"@id":"#b","@type":"Place","sameAs":"https://e.org/b","text":"Berlin city"}</script><script type="application/ld+json">{"@id":"http://www.wikidata.org/entity/Q64","@type":"Thing"}</script></head><body></body></html>'
    kb = spark.createDataFrame([("Berlin city", 1, "Q64", "Berlin", "label")], "search_label string, rank int, qid string, label string, match_type string")
    entities = spark.createDataFrame([("Q64", {"en": "Berlin"}, {}, [])], "qid string, labels map<string,string>, descriptions map<string,string>, claims array<struct<property:string,rank:int,type:string,value:string>>")
    row = build_graph(pages(spark, html), GraphOptions(), kb, entities).first()
    nodes = json.loads(row.document, object_pairs_hook=list)
    graph = dict(nodes)["@graph"]
    assert all(len({k for k, _ in n}) == len(n) for n in graph)
    (place,) = [dict(n) for n in graph if dict(n).get("@id") == "#b"]
    assert place["sameAs"] == ["https://e.org/b", "http://www.wikidata.org/entity/Q64"] and place["name"] == "Berlin"
    assert sum(dict(n).get("@id") == "http://www.wikidata.org/entity/Q64" for n in graph) == 1


def test_tracked_pages_and_stored_snapshots(spark):
    from pyspark.sql import functions as F

    at = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")
    a, b = pages(spark, "<p>one</p><p>two</p>"), pages(spark, "<p>one</p><p>three</p>")
    kept = track_pages(a, None, at(1))
    assert track_pages(b, kept, at(2), ReadOptions()).collect() == kept.collect()
    body, after = diff_stored(b, kept, at(3))
    text = body.first().body
    assert "--- 2024-01-01T00:00:00.000" in text and "+three" in text and "-two" in text
    assert [str(r.fetched_at)[:10] for r in after.collect()] == ["2024-01-03"]
    value = json.loads(diff_stored(b, after, at(4), DiffOptions(output="json", update=False))[0].first().body)
    assert value["summary"] == {"added": 0, "removed": 0, "changed": 0, "unchanged": 2}
    late = F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert json.loads(diff_stored(b, after, late, DiffOptions(output="json"))[0].first().body)["summary"]["added"] == 2
    assert diff_stored(b, after, late, DiffOptions(update=False))[1].collect() == after.collect()


def test_cached_reads(spark):
    from pyspark.sql import functions as F

    at = lambda m: F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp")
    p, text = pages(spark, "<p>one</p>", "<p>two</p>"), ReadOptions(format="text")
    first = cached_reads(p.filter("page_id = 0"), None, at(0), text)
    cache = upsert_cache(None, first, at(0))
    rows = {r.page_id: r for r in cached_reads(p, cache, at(1), text).collect()}
    assert {k: (r.cache, r.body) for k, r in rows.items()} == {0: ("HIT", "one"), 1: ("MISS", "two")}
    assert {r.cache for r in cached_reads(p, cache, at(9), text).collect()} == {"MISS"}
    assert {r.cache for r in cached_reads(p, cache, at(1), ReadOptions()).collect()} == {"MISS"}
    assert {r.cache for r in cached_reads(p, cache, at(1), ReadOptions(format="text", cache="bypass")).collect()} == {"MISS"}
    assert upsert_cache(cache, cached_reads(p, cache, at(6), text), at(6)).count() == 2


def test_sitemaps_linked_from_home_pages(spark):
    p = spark.createDataFrame([(1, "https://x.org/", '<link rel="sitemap" href="/own.xml">'), (2, "https://y.org/p", "<p>no")], "page_id long, url string, html string")
    res = spark.createDataFrame([("https://x.org/own.xml", 200, "text/xml", None, "<urlset><url><loc>https://x.org/a</loc></url></urlset>")], RES)
    rows = {r.origin: r for r in parse_sitemaps(p, res).collect()}
    assert rows["https://x.org"].sitemap_url == "https://x.org/own.xml" and rows["https://x.org"].code == 200 and rows["https://x.org"].body.startswith("<urlset>")
    assert rows["https://y.org"].code == 404 and parse_robots(p, res).filter("code = 404").count() == 2


TRACES = {
    "Next.js": '<script src="/_next/static/a.js"></script>', "Nuxt": '<div id="__nuxt"></div>', "Gatsby": '<div id="gatsby-focus-wrapper"></div>', "Remix": '<meta name="__remix-server" content="1">', "Astro": "<astro-island></astro-island>",
    "Angular": '<div ng-version="17"></div>', "Vue.js": "<div data-v-1a2b></div>", "Svelte": "<b>__sveltekit</b>", "React": '<div data-reactroot=""></div>', "Webpack": '<script id="__NEXT_DATA__">webpackChunk</script>',
    "Vite": '<script type="application/ld+json" src="/@vite/client"></script>', "Parcel": '<script type="application/ld+json">parcelRequire</script>', "WordPress": '<img src="/wp-content/a.png">', "Shopify": '<img src="//cdn.shopify.com/a">', "Wix": '<img src="//static.wixstatic.com/a">',
    "Squarespace": '<img src="//a.squarespace.com/b">', "Webflow": '<i class="x w-nav"></i>', "Docusaurus": '<meta name="generator" content="Docusaurus v3">', "Hugo": '<meta name="generator" content="Hugo 0.1">', "Jekyll": '<meta name="generator" content="Jekyll">',
    "Eleventy": '<meta name="generator" content="Eleventy">', "MkDocs": '<meta name="generator" content="mkdocs">', "Tailwind CSS": '<i class="flex px-2 py-3">x</i>', "Bootstrap": '<link href="/bootstrap.min.css">',
}


def test_framework_rules(spark):
    from quillmesh.operators.metadata import metadata

    rows = metadata(page_facts(with_fetch_columns(pages(spark, *TRACES.values(), "<p>plain")))).select("page_id", "frameworks").orderBy("page_id").collect()
    assert rows[-1].frameworks is None
    for (name, _), row in zip(TRACES.items(), rows):
        extra = {"Webpack": {"Next.js"}}.get(name, set())
        assert set(row.frameworks) == {name} | extra, name


def test_graphs_of_long_failing_and_rendered_pages(spark):
    """A page of many headings, sections as a plain walk finds them; one that can't be parsed stays a row; engines are kept."""
    import json
    import random

    r = random.Random(3)
    levels = [r.randrange(1, 7) for _ in range(400)]
    html = "<p>pre</p>" + "".join(f"<h{x}>h{k}</h{x}><p>t{k}</p>" for k, x in enumerate(levels))
    doc = json.loads(build_graph(pages(spark, html)).first()["document"])
    nodes = {n["@id"]: n for n in doc["@graph"]}
    sections = [n for n in doc["@graph"] if "#section-l" in n["@id"]]
    assert len(sections) == 401
    above, children = {}, {}
    for k, x in enumerate(levels):
        up = next((j for j in range(k - 1, -1, -1) if levels[j] < x), None)
        above[k] = up
        children.setdefault(up, []).append(k)
    ids = {int(n["name"][1:]): n["@id"] for n in sections if "name" in n}
    web = next(n for n in doc["@graph"] if n["@id"].endswith("#webpage"))
    assert [x["@id"] for x in web["hasPart"]["@list"]][1:] == [ids[k] for k in children[None]]
    for k, i in ids.items():
        assert nodes[i]["isPartOf"]["@id"] == (web["@id"] if above[k] is None else ids[above[k]])
        held = [x["@id"] for x in nodes[i]["hasPart"]["@list"]]
        assert [x for x in held if "#section-l" in x] == [ids[j] for j in children.get(k, [])]
        assert [nodes[x]["text"] for x in held if "#block" in x] == [f"t{k}"]
        own = children[above[k]].index(k) + (above[k] is None)  # the preamble is a section of the page, too
        assert i.endswith(f"-{own}")

    rows = spark.createDataFrame([(1, "https://x.org/a", "<p>short</p>", 200), (2, "https://x.org/b", None, 200)], "page_id long, url string, html string, status int")
    rendered = spark.createDataFrame([("https://x.org/a", "# From elsewhere\n\ntext")], "url string, content string")
    got = {r["page_id"]: r for r in read_pages(rows, ReadOptions(format="graph"), rendered=rendered).collect()}
    assert got[1]["engine"] == "rendered" and "From elsewhere" in got[1]["body"] and got[1]["error"] is None
    assert got[2]["engine"] == "dom" and got[2]["body"] is not None
    # a page that can't be parsed has no blocks: one row tells of it
    parsed = described(content_rows(pages(spark, "<p>x</p>"), ParseOptions(), ("facts", "linked", "blocks")), "blocks", "linked", "error")
    kind = parsed.schema["blocks"].dataType.simpleString()
    lost = graph_pairs(parsed.withColumns({"blocks": F.expr(f"CAST(NULL AS {kind})"), "error": F.lit("E: x")}), ("engine", "error")).collect()
    assert [(r["id"], r["error"]) for r in lost] == [(None, "E: x")]


def test_a_linked_graph_parses_each_page_once(spark):
    kb = spark.createDataFrame([("A", 1, "Q1", "A", "label")], "search_label string, rank int, qid string, label string, match_type string")
    frame = build_graph(pages(spark, "<h1>A</h1><p>text</p>"), GraphOptions(), kb, None)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the parse stage ran before, once, and its nodes are read from the checkpoint
    assert frame.count() == 1


def test_bad_linked_data_is_passed_over_in_reads(spark):
    html = '<head><script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"A", "n": 1},{"@type":"B"}]</script></head><p>x</p>'
    row = read_pages(pages(spark, html), ReadOptions(format="json")).first()
    assert row["error"] is None and '"jsonld":[{"@type":"A","n":1},{"@type":"B"}]' in row["body"]
    assert "jsonld" not in read_pages(pages(spark, '<head><script type="application/ld+json">{bad</script></head><p>x</p>'), ReadOptions(format="json")).first()["body"]


def as_lists(node):
    return [node.tag, node.attrs, node.spread, [c if isinstance(c, str) else as_lists(c) for c in node.children]]


def by_tokenizer(html):
    builder = H._Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def test_plain_markup_gives_the_tokenizers_tree():
    """Plain pages are read by one pattern, odd ones are left to the tokenizer; made of random pieces, both give one tree."""
    pieces = ["<p>", "</p>", "<P class='a b'>", "<a href=\"/x?a=1&b=2\">", "<a href='/y' Href=\"z\" hidden>", "</a>", "<br/>", "<img src=\"a>b\" />", "text &amp; more", "&lt", "&copy x", " \n", "<", "<>", "a < b", "</ p>", "<!-- c -- d -->", "<!-- c -->", "<!-->", "<!--->", "<!---->", "<!-- x --!>", "<!DOCTYPE html>", "<!doctype x [", "<?php x ?>", "<script>", "</script>", "<script>a && b</script>", "<script>if (a<b) '</p>'</script>", "<script src='s'/>", "<style>p > a {}</style>", "<title>", "</title>", "<title>A &amp; B</title>", "<title>a <b>c</b></title>", "<textarea>x &lt; y</textarea>", "<textarea><p></textarea>", "<iframe>x & &amp;</iframe>", "<noscript><p>x</p></noscript>", "<xmp>&amp;</xmp>", "<div", " id=x>", "<div id=x>", "<td data-a='1' a:b=\"2\">", "<table><tr>", "</table>", "<x-y>", "<é>", "<p\x0bx>", "<p a=\"1\"b=\"2\">", "<p / a>", "<svg><![CDATA[x]]></svg>", "</body>", "<html lang='en'>", "<body>", "<head>", "</p x>", "</p\n>", "é\x00", "&", "&#x41;", "&#65", "<plaintext>", "<li>", "</li/>"]
    rng = random.Random(4)
    plain = 0
    for _ in range(30_000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert as_lists(H.parse_html(html)) == as_lists(by_tokenizer(html)), html
        plain += H._plain(html) is not None
    assert plain > 3_000
    assert H._plain(PRODUCT) is not None and as_lists(H._plain(PRODUCT)) == as_lists(by_tokenizer(PRODUCT))


def test_what_is_the_pages_own_is_computed_once_a_page(spark):
    """Hints, author and time are bound before blocks are gone through, so that their expressions don't stand in the loop."""
    rows = parse_pages(with_fetch_columns(spark.createDataFrame([(1, "https://x.org/a", PRODUCT)], "page_id long, url string, html string")), want=("facts", "linked", "blocks"))
    rows = rows.withColumn("hints", C.linked_hints(F.col("linked")))
    plan = rows.select(C.classified(F.col("blocks"), F.col("hints"), F.col("page_id").cast("string")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    loops = plan[plan.index("transform(") :]
    # the outermost loop goes through one struct, in which the hints are
    assert "hints, filter(flatten(" in loops[loops.rindex("array(struct(") :]


def test_yaml_by_either_writer():
    """Records come out as the plain writer has them; the C writer takes most."""
    pieces = [" ", "  ", "a", "b c", ": ", ":", "#", " #", "- ", "-", "'", '"', "\\", "\n", "\t", "\r", "{", "}", "[", "]", ",", "&", "*", "!", "|", ">", "%", "@", "`", "?", "? ", "=", "~", "null", "yes", "No", "1", "1.5", "1e3", "0x1F", "2024-05-06", "12:30", "---", "...", "<<", "\u00e9", "\u2028", "\U0001f600", "\ufeff", "\x7f", "\x00", "word " * 30, "x" * 130]
    rng = random.Random(8)

    def value(depth):
        kind = rng.randint(0, 9 if depth else 5)
        said = "".join(rng.choice(pieces if rng.random() < 0.5 else pieces[:44]) for _ in range(rng.randint(0, 4)))
        if kind > 7:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind > 5:
            return {"".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([None, True, 3, -2.5, 1e20, 1e-7]) if kind == 5 else said

    quick = 0
    for _ in range(8_000):
        v = {"a": value(3), "".join(rng.choice(pieces[:44]) for _ in range(2)): value(2)}
        rec = json.dumps(v, ensure_ascii=rng.random() < 0.5)
        assert R.yaml_text(rec) == yaml.safe_dump(v, sort_keys=False, allow_unicode=True, width=float("inf")).rstrip()
        quick += not R._OTHERWISE.search(rec)
    assert quick > 1_500
    assert R._C_DUMPER is None or not R._OTHERWISE.search('{"title":"a: b \\"c\\"","n":[1,{"x":null}]}')


def test_traces_in_classes_are_those_of_the_whole_page(spark):
    """Classes are taken out of a page once; each rule finds in them what its pattern finds in the page, and is computed once."""
    pieces = ['class="', '"', "class=", "class='", "flex", " flex ", "inflex", "bg-red-5", "text-a-1", "min-h-screen", "space-x-", "x-space-x-1", "rounded-a", "px-2", "py-3", "astro-A", "sqs-", "w-a", "w-1", "data-v-0", "data-v-g", "svelte-a", "xclass=\"svelte-b", "\n", "<p ", ">", "=", "_"]
    rng = random.Random(5)
    found = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3_000)]
    frame = spark.createDataFrame([(h,) for h in found], "html string")
    tails = [rf"{EDGE}flex{EDGE}", rf"{EDGE}bg-[a-z]+-[0-9]", rf"{EDGE}space-x-", rf"{EDGE}px-[0-9]", "astro-[a-zA-Z0-9]", "sqs-", "w-[a-z]"]
    for x in tails:
        same = F.col("html").rlike(f'class="[^"]*{x}') == M.class_runs(F.col("html")).rlike(x)
        assert frame.filter(same).count() == len(found), x
        assert 0 < frame.filter(M.class_runs(F.col("html")).rlike(x)).count() < len(found)
    facts = parse_pages(with_fetch_columns(spark.createDataFrame([(1, "https://x.org/a", PRODUCT)], "page_id long, url string, html string")), want=("facts",))
    out = M.metadata(facts).select("frameworks", "jsonld")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wp-content/") == 1 and plan.count("[^\"]*") <= 2
    assert out.first()["frameworks"] == ["Hugo", "Tailwind CSS"]


def test_elements_are_known_without_a_walk(monkeypatch):
    """The elements of a tree come in the order of a walk, also of soup; facts and pruning walk no more."""
    pieces = ["<title>a", "</title>", "<meta name='a' content='b'>", "<head>", "</head>", "<body id='b'>", "</body>", "</html>", "<p>", "</p>", "<div id='d'>", "</div>", "<script>x</script>", "<script>", "<noscript><style>y</style>", "<iframe>", "text", " ", "<table><tr><td>", "</table>", "<li>", "<link rel='r' href='h'>", "<i v-cloak>", "<!-- c -->", "&amp", "<" ]
    rng = random.Random(9)

    def pruned(root):
        for node in [root, *root.walk()]:
            node.children = [c for c in node.children if not (isinstance(c, H.Node) and H._dropped(c))]
        return as_lists(root)

    for html in [PRODUCT, "<b>" * 700 + "<p>" + "</b>" * 3 + "<i>x" * 9, *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(5_000))]:
        root, elements = H.parse_elements(html)
        assert [id(n) for n in elements] == [id(n) for n in root.walk()], html
        H.prune(root, elements)
        if html.count("<b>") < 100:
            assert as_lists(root) == pruned(H.parse_html(html)), html
    monkeypatch.setattr(H.Node, "walk", lambda self: pytest.fail("walked"))
    root, elements = H.parse_elements(PRODUCT)
    assert P._facts_of(root, elements)["element_ids"] and not H.prune(root, elements)


def test_lists_of_structs_in_arrow():
    kind = pa.list_(pa.field("element", pa.struct([("a", pa.string()), ("b", pa.list_(pa.struct([("c", pa.int32())])))])))
    for values in ([], [None], [[]], [None, [{"a": "x"}, {"b": [{"c": 1}, {}]}], [], [{"b": []}, {"a": None, "b": None}], None], [[None, {"a": "y"}]]):
        assert P.arrow_of(values, kind).equals(pa.array(values, kind)) and P.arrow_of(values, kind).type == kind
        P.arrow_of(values, kind).validate(full=True)
