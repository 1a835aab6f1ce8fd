"""Whole reads: pages to bodies in a format.

A page is parsed once and stays one row: metadata, classification, markers and bodies are expressions
over that row, so rows that repeat a page, or have no page_id, are rows like others.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmesh import __version__
from quillmesh.functions.text import is_static
from quillmesh.operators import classify as C
from quillmesh.operators import discovery as N
from quillmesh.operators import markers as I
from quillmesh.operators.markdown_blocks import markdown_blocks
from quillmesh.operators.metadata import metadata, record
from quillmesh.operators.sections import flat_blocks, with_section
from quillmesh.plans.options import ReadOptions
from quillmesh.plans.toon import toon
from quillmesh.sources.pages import BLOCK, ParseOptions, is_html, parse_pages, slices, with_fetch_columns

OUT = ("page_id", "final_url", "status", "redirects", "engine", "format", "body", "error")
#: the names of a block's columns in JSON
NAMES = {"type": "type", "level": "level", "text": "text", "href": "href", "src": "src", "alt": "alt", "language": "language", "code": "code", "ordered": "ordered", "items": "items", "headers": "headers", "rows": "rows", "tag_name": "tagName", "html_id": "id", "html_class": "class", "classification": "classification", "confidence": "confidence", "marker": "marker"}


def info() -> dict:
    """What the engine offers."""
    return {"name": "quillmesh", "version": __version__, "reads": ["markdown", "json", "html", "text", "toon", "raw", "graph"], "markers": list(C.LABELS), "plans": ["read_pages", "cached_reads", "build_graph", "diff_pages", "diff_stored", "parse_robots", "parse_sitemaps"]}


#: signs, and keys that are long or empty, that the C writer, where there is one, puts otherwise than the plain one
_C_DUMPER = getattr(yaml, "CSafeDumper", None)
_OTHERWISE = re.compile(r'[^ -~]|\\[^"\\/]|"(?:|(?:[^"\\]|\\.){100,})"\s*:')


def yaml_text(rec: str) -> str:
    """A JSON record as YAML; the C writer takes those that it writes as the plain one does, most by far."""
    value = json.loads(rec)
    if _C_DUMPER is None or _OTHERWISE.search(rec):
        return yaml.safe_dump(value, sort_keys=False, allow_unicode=True, width=float("inf")).rstrip()
    return yaml.dump(value, Dumper=_C_DUMPER, sort_keys=False, allow_unicode=True, width=1 << 30).rstrip()


@F.pandas_udf(StringType())
def _yaml(records: pd.Series) -> pd.Series:
    return records.map(lambda r: None if r is None else yaml_text(r))


@F.pandas_udf(StringType())
def _toon(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else toon(json.loads(v)))


def frontmatter(rec: Column) -> Column:
    return F.concat(F.lit("---\n"), _yaml(rec), F.lit("\n---\n\n"))


def _nested(rows: list[dict]) -> list:
    """Section trees with their blocks, from a page's blocks in order."""
    root: list = []
    groups: dict = {}
    open_: list = []  # sections that a deeper heading would belong to
    content = None
    for r in rows:
        block, place = r["block"], r["place"]
        if block["type"] == "group":
            block["children"] = groups[place["ord"]] = []
        if place.get("parent_ord") is not None:
            groups[place["parent_ord"]].append(block)
        elif block["type"] == "heading":
            content = []
            section = {"heading": block.get("text"), "level": block["level"], "content": content, "children": []}
            while open_ and open_[-1]["level"] >= block["level"]:
                open_.pop()
            (open_[-1]["children"] if open_ else root).append(section)
            open_.append(section)
        else:
            if content is None:
                content = []
                root.append({"heading": None, "level": 0, "content": content, "children": []})
            content.append(block)
    return root


def with_content(rows: DataFrame, *more: str) -> DataFrame:
    """Adds ``content``, the section tree as JSON, in place of ``blocks``; ``more`` names fields beyond the parsed ones."""
    own = [f.split(" ")[0] for f in BLOCK.split(", ")]
    fields = [(c, n) for c, n in NAMES.items() if c in own or c in more]
    row = lambda b: F.struct(F.struct(*[b[c].alias(n) for c, n in fields]).alias("block"), F.struct(b["ord"].alias("ord"), b["parent_ord"].alias("parent_ord")).alias("place"))
    flat = rows.select(*[c for c in rows.columns if c != "blocks"], F.to_json(F.transform("blocks", row)).alias("content"))

    def nest(batches):
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            trees = [json.dumps(_nested(json.loads(b)) if b is not None else [], ensure_ascii=False, separators=(",", ":")) for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(trees, pa.string())], names=batch.schema.names)

    return flat.mapInArrow(nest, flat.schema)


def site_files(pages: DataFrame) -> DataFrame:
    """Adds ``site_kind`` and ``wanted``: the data files that a static site generator publishes for the page."""
    origin = F.regexp_extract("final_url", r"^https?://[^/?#]+", 0)
    path = F.regexp_replace(F.regexp_extract("final_url", r"^https?://[^/?#]+([^?#]*)", 1), "/?$", "/")
    gatsby = F.col("html").contains('id="___gatsby"') | F.col("html").contains("gatsby-")
    docusaurus = F.col("html").contains("docusaurus") | F.col("html").contains('generator" content="Docusaurus')
    assets = F.array_distinct(F.regexp_extract_all("html", F.lit(r'"(/assets/[^"]+\.json)"'), F.lit(1)))
    kind = F.when(is_html(F.col("content_type")), F.when(gatsby, "Gatsby").when(docusaurus, "Docusaurus"))
    none = F.array().cast("array<string>")
    wanted = F.when(F.col("site_kind") == "Gatsby", F.array(F.concat(origin, F.lit("/page-data"), path, F.lit("page-data.json")))).when(F.col("site_kind") == "Docusaurus", F.transform(assets, lambda a: F.concat(origin, a))).otherwise(none)
    return pages.withColumn("site_kind", kind).withColumn("wanted", wanted)


def with_site_data(pages: DataFrame, resources: DataFrame | None) -> DataFrame:
    """Adds site_kind and site, the bodies of a page's data files in order; other pages take no part in the join."""
    if resources is None:
        return pages.withColumns({"site_kind": F.lit(None).cast("string"), "site": F.lit(None).cast("array<string>")})
    found = site_files(pages)
    key = [F.col("final_url").alias("_u"), F.xxhash64("html").alias("_h")]
    asked = found.filter(F.size("wanted") > 0).select(*key, "wanted").distinct().select("_u", "_h", F.posexplode("wanted").alias("pos", "url"))
    bodies = N.one_each(resources.filter("status = 200"), "url", "body")
    sites = asked.join(bodies, "url").groupBy("_u", "_h").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]).alias("site"))
    plain = found.filter(F.size(F.coalesce("wanted", F.array().cast("array<string>"))) == 0).withColumn("site", F.lit(None).cast("array<string>"))
    joined = found.filter(F.size("wanted") > 0).join(sites, (F.col("final_url") == F.col("_u")) & (F.xxhash64("html") == F.col("_h")), "left").drop("_u", "_h")
    return plain.unionByName(joined).drop("wanted")


def rendered_pages(rendered: DataFrame, with_blocks: bool) -> DataFrame:
    """(url, content, title, description, md_blocks), one row a url: pages rendered elsewhere, as markdown and as blocks."""
    more = {c: F.lit(None).cast("string") for c in ("title", "description") if c not in rendered.columns}
    rows = N.one_each(rendered.withColumns(more).filter("content <> ''"), "url", "content", "title", "description")
    if not with_blocks:
        return rows
    found = markdown_blocks(rows, "url", "content").withColumns({"depth": F.lit(0), "parent_ord": F.lit(None).cast("int")})
    found = with_section(found, "id")
    missing = {c: F.lit(None).cast(t) for c, t in (f.split(" ", 1) for f in BLOCK.split(", ")) if c not in found.columns}
    listed = found.withColumns(missing).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f.split(" ", 1)[0]).cast(f.split(" ", 1)[1]).alias(f.split(" ", 1)[0]) for f in BLOCK.split(", ")]))).alias("md_blocks"))
    return rows.join(listed.withColumnRenamed("id", "url"), "url", "left")


def content_rows(pages: DataFrame, parse: ParseOptions, want: tuple[str, ...], resources: DataFrame | None = None, rendered: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed pages with what the network tables add: site data, robots sitemaps, rendered pages (``fallback``)."""
    pages = with_site_data(with_fetch_columns(pages), resources)
    pages = N.with_companions(pages, resources) if resources is not None else pages.withColumn("robots_sitemap", F.lit(None).cast("string"))
    if rendered is not None:
        want = (*want, "text", "html")
    rows = parse_pages(pages, parse, want, ("site_kind", "robots_sitemap", *keep))
    if rendered is None:
        return rows.withColumns({"fallback": F.lit(None).cast("string")})
    blocks = "blocks" in want
    found = rendered_pages(rendered, blocks)
    found = found.select(F.col("url").alias("_u"), F.col("content").alias("_c"), F.col("title").alias("_t"), F.col("description").alias("_d"), *["md_blocks"] * blocks)
    thin = ~is_static(F.trim(F.coalesce("text_content", F.lit(""))), F.coalesce("body_html", F.lit("")))
    # pages with content of their own look for an address that no page has, each another one
    rows = rows.withColumn("_k", F.when(thin, F.col("url")).otherwise(F.concat(F.lit("\n"), F.xxhash64("url", "page_id").cast("string"))))
    rows = rows.join(found, F.col("_k") == F.col("_u"), "left")
    hit = F.col("_u").isNotNull()
    new = {"fallback": F.when(hit, F.col("_c")), "engine": F.when(hit, "rendered").otherwise(F.col("engine")), "text_content": F.coalesce("_c", "text_content"), "body_html": F.when(hit, F.concat(F.lit("<pre>"), "_c", F.lit("</pre>"))).otherwise(F.col("body_html"))}
    if blocks:
        new["blocks"] = F.when(hit, F.coalesce("md_blocks", F.array().cast(rows.schema["blocks"].dataType))).otherwise(F.col("blocks"))
    return rows.withColumns(new).withColumnsRenamed({"_t": "rendered_title", "_d": "rendered_description"}).drop("_k", "_u", "_c", "md_blocks")


def described(rows: DataFrame, *keep: str) -> DataFrame:
    """Metadata of content rows; a rendered page's own title and description win."""
    more = ["rendered_title", "rendered_description"] if "rendered_title" in rows.columns else []
    out = metadata(rows, *keep, *more)
    for c in ("title", "description") if more else ():
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(f"rendered_{c}"), F.lit("")), c))
    return out.drop(*more)


def _others(pages: DataFrame, format_: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bodies that aren't HTML, as they are."""
    raw = with_fetch_columns(pages).filter(~is_html(F.col("content_type")))
    return raw.select("page_id", "final_url", "status", "redirects", F.lit("raw").alias("engine"), F.lit(format_).alias("format"), F.col("html").alias("body"), F.lit(None).cast("string").alias("error"), *keep)


def read_pages(pages: DataFrame, options: ReadOptions = ReadOptions(), resources: DataFrame | None = None, rendered: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, final_url, status, redirects, engine, format, body, error), a row for each row of pages.

    ``resources`` (url, status, content_type, location, body) stands for the network: robots files and
    site data are looked up there.  ``rendered`` (url, content and, if known, title and description)
    holds markdown of pages rendered elsewhere, for those without content of their own.  Whatever a
    page's content comes from, every format shows it.  Bodies that aren't HTML come back as they are;
    graphs are of HTML pages alone.  Columns of pages named in ``keep`` are carried.
    """
    if options.format == "raw":
        return with_fetch_columns(pages).select("page_id", "final_url", "status", "redirects", F.lit("raw").alias("engine"), F.lit("raw").alias("format"), F.col("html").alias("body"), F.lit(None).cast("string").alias("error"), *keep)
    if options.format == "graph":
        from quillmesh.plans.graph import graph_bodies

        return graph_bodies(pages, options, resources, rendered, keep)
    parse = ParseOptions(options.selector, options.links, options.images, options.bare_references)
    enrich = bool(options.marker) or options.classify and options.format != "markdown"
    want = {"text": ("text",), "html": ("html",), "markdown": ("facts", "linked", "blocks") if options.marker else ("facts", "markdown")}.get(options.format, ("facts", "linked", "blocks") if enrich else ("facts", "blocks"))
    rows = content_rows(pages, parse, want, resources, rendered, keep)
    if options.format in ("text", "html"):
        body = rows.withColumn("body", F.col("text_content" if options.format == "text" else "body_html"))
    else:
        kept = [c for c in ("linked", "blocks", "body_markdown", "fallback", "error", *keep) if c in rows.columns]
        meta = described(rows, *kept).withColumn("rec", record())
        if enrich:
            hints = C.linked_hints(F.col("linked"))
            meta = meta.withColumn("hints", hints).withColumn("blocks", C.classified(F.col("blocks"), F.col("hints"), F.col("author"), F.col("published_time")))
        if options.marker:
            meta = meta.withColumn("blocks", I.marked(F.col("blocks"), list(options.marker)))
        if options.format == "markdown":
            own = I.marked_markdown(flat_blocks(F.col("blocks"))) if options.marker else F.coalesce("fallback", "body_markdown")
            md = F.concat(F.coalesce(own, F.lit("")), F.lit("\n"))
            body = meta.withColumn("body", F.concat(frontmatter(F.col("rec")), md) if options.frontmatter else md)
        else:
            more = ("classification", "confidence") * enrich + ("marker",) * bool(options.marker)
            told = with_content(meta.select("page_id", "final_url", "status", "redirects", "engine", "error", *keep, "rec", "blocks"), *more)
            value = F.concat(F.lit('{"metadata":'), F.col("rec"), F.lit(',"content":'), F.col("content"), F.lit("}"))
            body = told.withColumn("body", value if options.format == "json" else _toon(value))
    done = body.withColumn("format", F.lit(options.format)).select(*[F.coalesce("redirects", F.array().cast("array<string>")).alias(c) if c == "redirects" else c for c in OUT], *keep)
    return done.unionByName(_others(pages, options.format, keep))
