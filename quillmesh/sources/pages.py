"""The parse stage: every page's HTML becomes one tree, in Arrow batches, from which facts, text, blocks and markdown are read.

A plan names what it wants and gets it on the page's own row, so nothing is joined back to a page.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillmesh.sources.blocks import block_rows
from quillmesh.sources.emit import Style, markdown
from quillmesh.sources.html import DEEPEST, inner_html, parse_elements, parse_html, prune, select_first
from quillmesh.sources.reconstruct import loads, reconstruct, sentences, space_out

BLOCK = "ord int, parent_ord int, depth int, section_ord int, type string, level int, text string, href string, src string, alt string, language string, code string, ordered boolean, items array<struct<text:string,href:string>>, headers array<string>, rows array<array<string>>, tag_name string, html_id string, html_class string, href_url string, src_url string"
#: what a plan can ask for, with the columns that it gets; engine and error come always
WANTS = {
    "facts": "lang string, title_tag string, meta_tags array<struct<property:string,name:string,content:string>>, links array<struct<rel:string,href:string>>, script_srcs array<string>, inline_scripts string, element_ids array<string>, has_astro boolean, has_cloak boolean, generator string, jsonld array<string>, recovered_title string",
    "linked": "linked array<struct<id:string,types:array<string>,props:string>>",
    "text": "text_content string",
    "html": "body_html string",
    "blocks": f"blocks array<struct<{re.sub(r'(\w+) ', r'\1:', BLOCK).replace(', ', ',')}>>",
    "markdown": "body_markdown string",
}
CARRIED = ("page_id", "url", "final_url", "status", "content_type", "redirects", "html")
HTML_TYPE = "text/html; charset=utf-8"
#: bytes of HTML that are parsed before rows are handed on
CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class ParseOptions:
    """Plan-time constants of the parse stage."""

    selector: str | None = None
    links: str = "inline"
    images: str = "keep"
    #: whether a reference without its semicolon (&amp) is one, as in browsers, or plain text; or the names that are one
    bare_references: bool | tuple[str, ...] = True


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fetch_columns(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def with_fetch_columns(pages: DataFrame) -> DataFrame:
    """What a fetch would have told, with defaults for what the table doesn't hold."""
    defaults = {"final_url": F.col("url"), "status": F.lit(200), "content_type": F.lit(HTML_TYPE), "redirects": F.array().cast("array<string>")}
    return pages.withColumns({k: v for k, v in defaults.items() if k not in pages.columns})


def is_html(content_type):
    """Whether a body is parsed at all: types that name html or xml, or none."""
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return (c == "") | c.contains("html") | c.contains("xml")


@functools.cache
def _bare(names: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """References without a semicolon but those named; the same, or a script or style."""
    bare = "&(?!#?[A-Za-z0-9_]+;" + "".join(f"|{re.escape(n)}" for n in names) + ")"
    return re.compile(bare), re.compile(rf"((?is:<(script|style)\b.*?</\2\s*>))|{bare}")


def without_bare_references(html: str, names: tuple[str, ...] = ()) -> str:
    """HTML whose references without a semicolon, but those named, stand for themselves; scripts and styles hold none."""
    any_, all_ = _bare(tuple(names))
    return all_.sub(lambda m: m[1] or "&amp;", html) if any_.search(html) else html


def read_references(html: str, bare: bool | tuple[str, ...]) -> str:
    """HTML for the tokenizer, which reads references as browsers do (see ``ParseOptions``)."""
    return html if bare is True else without_bare_references(html, bare or ())


def _cleaned(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _target(root, selector: str | None):
    found = select_first(root, selector) if selector else None
    return found or next(n for n in root.children if n.tag == "body")


def recovered(html: str, root) -> tuple[str, str, str] | None:
    """(html, text, title) from hydration data, for pages that show next to no text.

    Framework payloads are tried in order; a later one overrides an earlier one, islands override
    both, and without islands any prose that was gathered overrides all.
    """
    best, prose = None, []
    next_data = next((n for n in root.walk() if n.tag == "script" and n.get("id") == "__NEXT_DATA__"), None)
    remix = re.search(r"window\.__remixContext\s*=\s*(\{.*?\});", html, re.S)
    for value in (loads("".join(c for c in next_data.children if isinstance(c, str))) if next_data else None, loads(remix[1]) if remix else None):
        if value is None:
            continue
        found = reconstruct(value)
        if found and len(found["text"]) > 100:
            best = (found["html"], found["text"], found["title"] or (best[2] if best else ""))
        else:
            prose += sentences(value)
    islands = ""
    for island in (n for n in root.walk() if n.tag == "astro-island"):
        value = loads(island.get("props"))
        if value is None:
            continue
        found = reconstruct(value)
        if found and len(found["text"]) > 50:
            islands += found["html"] + "\n"
        else:
            prose += sentences(value)
    title = best[2] if best else ""
    if islands:
        return islands, _target(parse_html(islands), None).text(), title
    if prose:
        once = list(dict.fromkeys(prose))
        return "\n".join(f"<p>{s}</p>" for s in once), "\n\n".join(once), title
    return best


#: elements that facts are told by, beyond their ids
_TOLD = frozenset(("astro-island", "meta", "link", "title", "script"))


def _facts_of(root, elements) -> dict:
    """What metadata and framework rules need of a tree that isn't pruned yet, and of its elements in document order."""
    metas, links, srcs, inline, ids, linked, generator, title_tag = [], [], [], [], [], [], "", None
    astro = cloak = False
    for n in elements:
        if n.attrs:
            if n.attrs.get("id"):
                ids.append(n.attrs["id"])
            cloak |= "v-cloak" in n.attrs
        if n.tag not in _TOLD:
            continue
        astro |= n.tag == "astro-island"
        if n.tag == "meta":
            metas.append({"property": n.get("property"), "name": n.get("name"), "content": n.get("content")})
            if n.get("name") == "generator" and not generator:
                generator = (n.get("content") or "").lower()
        elif n.tag == "link":
            links.append({"rel": n.get("rel"), "href": n.get("href")})
        elif n.tag == "title" and title_tag is None:
            title_tag = n.text().strip()
        elif n.tag == "script":
            kept = n.get("id") == "__NEXT_DATA__" or n.get("type") == "application/ld+json"
            body = "".join(c for c in n.children if isinstance(c, str))
            if kept and n.get("src"):
                srcs.append(n.get("src"))
            if kept and body:
                inline.append(body)
            if n.get("type") == "application/ld+json" and body:
                linked.append(body)
    return {"lang": root.get("lang"), "title_tag": title_tag or None, "meta_tags": metas, "links": links, "script_srcs": srcs, "inline_scripts": "\n".join(inline), "element_ids": ids, "has_astro": astro, "has_cloak": cloak, "generator": generator, "jsonld": linked}


def linked_nodes(texts: list[str]) -> list[dict]:
    """Linked-data objects of a page: arrays and @graph opened, by id once."""
    seen: set = set()
    out = []
    todo = [v for v in map(loads, reversed(texts)) if v is not None]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict) and isinstance(x.get("@graph"), list):
            todo.append(x["@graph"])
        elif isinstance(x, dict):
            own = {k: v for k, v in x.items() if k != "@context"}
            id_ = own.get("@id") if isinstance(own.get("@id"), str) else None
            if id_ and id_ in seen:
                continue
            seen.add(id_)
            kind = own.get("@type")
            kinds = [str(k) if not isinstance(k, dict) else "Thing" for k in (kind if isinstance(kind, list) else [kind] if kind else [])]
            out.append({"id": id_, "types": kinds, "props": json.dumps(own, ensure_ascii=False, separators=(",", ":"))})
    return out


def site_content(bodies) -> dict | None:
    """Content from the first of a site's data files that gives any."""
    for body in bodies or []:
        found = reconstruct(loads(body))
        if found:
            return found
    return None


def parse_page(html: str, base: str, options: ParseOptions, want, site=None) -> dict:
    """The wanted columns of one page.  ``site`` holds the bodies of its site's data files, which come before its own content."""
    html = read_references(html, options.bare_references)
    root, elements = parse_elements(space_out(html))
    out = _facts_of(root, elements) if "facts" in want or "linked" in want else {}
    if "linked" in want:
        out["linked"] = linked_nodes(out["jsonld"])
    prune(root, elements)
    node = _target(root, options.selector)
    text, own_html, engine, title = node.text().strip(), None, "dom", ""
    found = site_content(site)
    if found:
        own_html, text, title = found["html"], found["text"], found["title"]
    elif len(text) < 100:
        hydrated = recovered(html, root)
        if hydrated:
            own_html, text, title = hydrated
    if own_html is not None:
        engine = "json-reconstructor"
        if "blocks" in want or "markdown" in want:
            node = _target(parse_html(own_html), None)
    style = Style(base, options.links, options.images)
    out |= {"engine": engine, "recovered_title": title or None, "from_site": bool(found)}
    if "text" in want:
        out["text_content"] = _cleaned(text)
    if "html" in want:
        out["body_html"] = own_html if own_html is not None else inner_html(node)
    if "blocks" in want:
        out["blocks"] = block_rows(node, style)
    if "markdown" in want:
        out["body_markdown"] = markdown(node, style)
    return out


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about CHUNK_BYTES of a text column, a row at least, so that what Python makes of it stays small."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    i = 0
    while i < batch.num_rows:
        j, held = i, 0
        while j < batch.num_rows and (j == i or held + sizes[j] <= CHUNK_BYTES):
            held += sizes[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j


def arrow_of(values: list, kind: pa.DataType) -> pa.Array:
    """As pa.array gives it; lists of structs are built field by field, which takes a part of the time."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    flat = [x for v in values if v is not None for x in v]
    if None in flat:
        return pa.array(values, kind)
    starts, n = [], 0
    for v in values:
        starts.append(None if v is None else n)
        n += len(v or ())
    fields = list(kind.value_type)
    structs = pa.StructArray.from_arrays([arrow_of([x.get(f.name) for x in flat], f.type) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array([*starts, n], pa.int32()), structs, type=kind)


def parse_pages(pages: DataFrame, options: ParseOptions = ParseOptions(), want: tuple[str, ...] = ("facts", "text"), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of pages that is HTML: the fetch columns, ``keep``, engine, error and what is wanted (see WANTS).

    Each page is parsed once.  A page that can't be parsed stays a row with its error; null HTML is an
    empty page; rows that repeat a page, or have no page_id, are rows like others.  A column ``site``
    (array of JSON texts), if there is one, is the page's site data.
    """
    given = [*CARRIED, *[c for c in keep if c not in CARRIED]]
    if "site" in pages.columns and "site" not in given:
        given.append("site")
    slim = pages.filter(is_html(F.col("content_type"))).select(*given)
    new = StructType.fromDDL(", ".join([WANTS[w] for w in WANTS if w in want] + ["engine string", "from_site boolean", "error string"]))
    schema = StructType([*slim.schema.fields, *new.fields])
    fields = list(to_arrow_schema(new))
    at = {c: k for k, c in enumerate(given)}

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
        for whole in batches:
            for batch in slices(whole, at["html"]):
                sites = batch.column(at["site"]).to_pylist() if "site" in at else [None] * batch.num_rows
                rows = []
                for html, final, url, site in zip(*[batch.column(at[c]).to_pylist() for c in ("html", "final_url", "url")], sites):
                    try:
                        rows.append(parse_page(html or "", final or url or "", options, want, site) | {"error": None})
                    except Exception as e:  # a page that can't be parsed stays a row
                        rows.append({"engine": None, "error": f"{type(e).__name__}: {e}"})
                new_columns = [arrow_of([r.get(f.name) for r in rows], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new_columns], names=[*given, *[f.name for f in fields]])

    return slim.mapInArrow(run, schema)


def page_facts(pages: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """What metadata, framework rules and text need, with the page's HTML."""
    return parse_pages(pages, options, ("facts", "linked", "text"))


def exploded(parsed: DataFrame, *keep: str) -> DataFrame:
    """A row for each block of ``blocks``, with page_id, url and the kept columns."""
    return parsed.select("page_id", "url", *keep, F.explode("blocks").alias("_b")).select("page_id", "url", *keep, "_b.*")


def page_blocks(pages: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Typed blocks of every HTML page: one row each, ``ord`` in document order, groups by ``parent_ord``."""
    return exploded(parse_pages(pages, options, ("blocks",)))


def reconstructed(frame: DataFrame, json_col: str) -> DataFrame:
    """Adds ``best`` (html, text, title, kind, score), the reconstruction of a JSON column; bad JSON gives null."""

    @F.pandas_udf("html string, text string, title string, kind string, score long")
    def best(column: pd.Series) -> pd.DataFrame:
        found = [reconstruct(loads(x)) if x is not None else None for x in column]
        return pd.DataFrame([f or dict.fromkeys(("html", "text", "title", "kind", "score")) for f in found], columns=["html", "text", "title", "kind", "score"]).astype({"score": "Int64"})

    found = best(F.col(json_col))
    return frame.withColumn("best", F.when(found["kind"].isNotNull(), found))


def jsonld_nodes(facts: DataFrame) -> DataFrame:
    """(page_id, node_ord, id, types, props): the linked-data objects of ``linked`` as rows."""
    return facts.select("page_id", F.posexplode("linked").alias("node_ord", "x")).select("page_id", "node_ord", "x.id", "x.types", "x.props")
