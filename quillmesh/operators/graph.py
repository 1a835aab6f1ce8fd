"""Knowledge graphs of pages: node rows from metadata, sections, blocks and linked data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.hashing import fnv1a_expr
from quillmesh.functions.patterns import VALUES, java
from quillmesh.functions.text import trimmed
from quillmesh.functions.urls import document_base
from quillmesh.operators.classify import block_text

# The context of every document, and the types that can be a page's main entity.
CONTEXT = '["https://schema.org",{"wd":"http://www.wikidata.org/entity/","wdt":"http://www.wikidata.org/prop/direct/","rdfs":"http://www.w3.org/2000/01/rdf-schema#","skos":"http://www.w3.org/2004/02/skos/core#"}]'
MAIN_TYPES = ("Article", "NewsArticle", "BlogPosting", "ScholarlyArticle", "Product", "SoftwareApplication", "WebApplication", "FAQPage", "HowTo", "Recipe", "Event", "Organization", "LocalBusiness", "Person")
_PRICE, _RATING, _EMAIL = (java(VALUES[k]) for k in ("price", "rating", "email"))
_PHONE = VALUES["phone"]  # a class: ASCII white space will do


def _got(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def offer(text: Column) -> Column:
    """struct(price, currency) of the first price in a text; null without one."""
    amount = F.coalesce(_got(text, _PRICE, 1), _got(text, _PRICE, 2))
    currency = F.coalesce(_got(text, _PRICE, 3), F.when(text.contains("€"), "EUR").when(text.contains("£"), "GBP").otherwise("USD"))
    return F.when(text.rlike(_PRICE), F.struct(F.regexp_replace(amount, ",", "").alias("price"), currency.alias("currency")))


def rating(text: Column) -> Column:
    return F.coalesce(_got(text, _RATING, 1), _got(text, _RATING, 2)).cast("double")


def contact(text: Column) -> Column:
    """struct(email, phone): the first of each."""
    return F.struct(_got(text, _EMAIL).alias("email"), F.nullif(trimmed(_got(text, _PHONE)), F.lit("")).alias("phone"))


def _pairs(**props: Column) -> Column:
    """Properties as (name, JSON value) pairs without absent ones."""
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("prop"), v.alias("value"))) for k, v in props.items()]))


def quoted(c: Column) -> Column:
    """A string as a JSON value."""
    return F.when(c.isNotNull(), F.btrim(F.to_json(F.array(c)), F.lit("[]")))  # what is left begins and ends with a quotation mark


def json_values(values: Column) -> Column:
    """Strings as JSON: one as it is, several as an array, none as null."""
    each = F.transform(values, quoted)
    return F.when(F.size(values) == 1, each[0]).when(F.size(values) > 1, F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))


def _ref(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit('{"@id":'), quoted(c), F.lit("}")))


def _refs(ids: Column) -> Column:
    return F.concat(F.lit('{"@list":['), F.array_join(F.transform(ids, lambda i: F.concat(F.lit('{"@id":'), quoted(i), F.lit("}"))), ","), F.lit("]}"))


def _node(k: int, ord_: Column, id_: Column, type_: Column, pairs: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), ord_.cast("int").alias("o"), id_.alias("id"), type_.alias("type"), pairs.alias("pairs"))


def block_node(b: Column, key: Column, base: Column) -> Column:
    """The node of a top-level block that is no section heading; a group is one element without text, and its blocks have none.

    ``b`` has the block's fields and its text as ``said``; ``key`` is its block key.
    """
    text, kind, own = b["said"], b["type"], F.coalesce(b["classification"], b["type"])
    cut = lambda n: F.nullif(F.substring(text, 1, n), F.lit(""))
    is_ = lambda name: (kind == name) | (own == name)
    labelled = lambda name: (own == name) & (text != "")
    entry = lambda x, i: F.concat(F.lit('{"@type":"ListItem","position":'), (i + 1).cast("string"), F.lit(',"name":'), quoted(F.coalesce(x["text"], F.lit(""))), F.coalesce(F.concat(F.lit(',"item":'), quoted(F.nullif(x["href"], F.lit("")))), F.lit("")), F.lit("}"))
    sale, who, stars = offer(text), contact(text), rating(text)
    cases = (
        (is_("image"), "ImageObject", _pairs(contentUrl=quoted(b["src_url"]), caption=quoted(F.coalesce(F.nullif(b["alt"], F.lit("")), b["text"])))),
        (is_("code"), "SoftwareSourceCode", _pairs(text=quoted(F.coalesce(b["code"], text)), programmingLanguage=quoted(F.nullif(b["language"], F.lit(""))))),
        (is_("list"), "ItemList", _pairs(itemListElement=F.concat(F.lit("["), F.array_join(F.transform(b["items"], entry), ","), F.lit("]")))),
        (is_("table"), "Table", _pairs(description=quoted(cut(500)))),
        (labelled("rating"), "AggregateRating", _pairs(ratingValue=stars.cast("string"), bestRating=F.when(stars.isNotNull(), "5"), description=quoted(cut(240)))),
        (labelled("pricing") & sale.isNotNull(), "Offer", _pairs(price=quoted(sale["price"]), priceCurrency=quoted(sale["currency"]), description=quoted(cut(240)))),
        (labelled("product"), "Product", _pairs(name=quoted(cut(160)), description=quoted(cut(500)))),
        (labelled("author"), "Person", _pairs(name=quoted(cut(120)))),
        (labelled("contact"), "ContactPoint", _pairs(description=quoted(cut(240)), email=quoted(who["email"]), telephone=quoted(who["phone"]))),
        (is_("link"), "WebPageElement", _pairs(url=quoted(b["href_url"]), name=quoted(F.nullif(b["text"], F.lit(""))))),
        (is_("heading"), "WebPageElement", _pairs(name=quoted(F.nullif(text, F.lit(""))), headline=quoted(F.nullif(text, F.lit(""))), position=b["level"].cast("string"))),
        (kind == "blockquote", "Quotation", _pairs(text=quoted(F.nullif(text, F.lit(""))))),
    )
    type_, pairs = F.lit("WebPageElement"), _pairs(text=quoted(F.nullif(text, F.lit(""))))
    for cond, name, props in reversed(cases):
        type_, pairs = F.when(cond, F.lit(name)).otherwise(type_), F.when(cond, props).otherwise(pairs)
    return _node(1, b["ord"], F.concat(base, F.lit("#block-"), F.replace(key, F.lit(":"), F.lit("-"))), type_, pairs)


def main_id(linked: Column) -> Column:
    """The id of the first linked-data node of a main type that has one."""
    plain = lambda types: F.transform(types, lambda t: F.regexp_replace(F.regexp_replace(t, r"(?i)^https?://schema\.org/", ""), "(?i)^schema:", ""))
    fit = F.filter(linked, lambda n: n["id"].isNotNull() & F.arrays_overlap(plain(n["types"]), F.array(*map(F.lit, MAIN_TYPES))))
    return F.try_element_at(fit, F.lit(1))["id"]


def linked_node(n: Column, i: Column) -> Column:
    """The node of a linked-data object, its properties as they are."""
    value = lambda e: F.when(e["value"].rlike(r"^[\[{]"), e["value"]).otherwise(quoted(e["value"]))
    props = F.filter(F.map_entries(F.from_json(n["props"], "map<string,string>")), lambda e: ~e["key"].isin("@id", "@type"))
    pairs = F.transform(props, lambda e: F.struct(e["key"].alias("prop"), value(e).alias("value")))
    return _node(2, i, F.coalesce(n["id"], F.concat(F.lit("_:anon"), i.cast("string"))), F.try_element_at(n["types"], F.lit(1)), pairs)


def with_sections(rows: DataFrame) -> DataFrame:
    """Adds ``sections``, an array of (ord, level, heading, above, place, at, until, last) of each page's sections in order.

    ``rows`` hold ``tops``, the blocks outside groups.  A section's parent is the nearest earlier heading of a
    smaller level: ``above`` is its index in the array, null without one, and ``place`` counts earlier sections of
    the same parent.  Its own blocks are those of ``tops`` from index ``at`` to before ``until``, the sections
    below it those up to index ``last``.  Blocks before any heading make one section without a heading, of level
    0 and ord -1.

    One fold keeps the open headings, at most one a level, as a stack; a second one from the end keeps where each
    level was met last.  So a page of many headings takes time in proportion to them.
    """
    said = lambda b, i: F.struct(b["ord"].alias("ord"), b["level"].alias("level"), b["text"].alias("heading"), (b["type"] == "heading").alias("head"), i.alias("i"))
    rows = rows.withColumn("_heads", F.filter(F.transform("tops", said), lambda x: x["head"]))
    loose = F.coalesce(F.try_element_at("_heads", F.lit(1))["i"], F.size("tops")) > 0
    first = F.struct(F.lit(-1).alias("ord"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("heading"), F.lit(True).alias("head"), F.lit(-1).alias("i"))
    rows = rows.withColumn("_heads", F.when(loose, F.concat(F.array(first), "_heads")).otherwise(F.col("_heads")))
    open_ = "array<struct<k:int,level:int,n:int>>"
    start = F.struct(F.array().cast(open_).alias("stack"), F.lit(0).alias("roots"), F.array().cast("array<struct<above:int,place:int>>").alias("out"))

    def step(state, x):
        # headings that the new one does not close, and with the last of them counting one section more
        stay = F.filter(state["stack"], lambda y: (y["level"] < x["level"]) & (x["level"] > 0))
        top = F.try_element_at(stay, F.lit(-1))
        counted = F.transform(stay, lambda y: F.struct(y["k"].alias("k"), y["level"].alias("level"), F.when(y["k"] == top["k"], y["n"] + 1).otherwise(y["n"]).alias("n")))
        own = F.struct(F.size(state["out"]).alias("k"), x["level"].alias("level"), F.lit(0).alias("n"))
        pushed = F.when(x["level"] > 0, F.array_append(counted, own)).otherwise(counted)
        placed = F.struct(top["k"].alias("above"), F.coalesce(top["n"], state["roots"]).alias("place"))
        return F.struct(pushed.alias("stack"), (state["roots"] + top["k"].isNull().cast("int")).alias("roots"), F.array_append(state["out"], placed).alias("out"))

    size = F.size("_heads")
    none = F.struct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda _: size).alias("next"), F.array().cast("array<int>").alias("out"))

    def back(state, x):
        k = size - 1 - F.size(state["out"])
        last = F.array_min(F.slice(state["next"], F.lit(1), x["level"] + 1))
        return F.struct(F.transform(state["next"], lambda y, i: F.when(i == x["level"], k).otherwise(y)).alias("next"), F.array_append(state["out"], last).alias("out"))

    rows = rows.withColumns({
        "_up": F.aggregate("_heads", start, step, lambda state: state["out"]),
        "_down": F.reverse(F.aggregate(F.reverse("_heads"), none, back, lambda state: state["out"])),
    })
    rows = rows.withColumn("_zip", F.arrays_zip("_heads", "_up", "_down"))
    until = lambda i: F.coalesce(F.try_element_at("_heads", i + 2)["i"], F.size("tops"))
    section = lambda z, i: F.struct(*[z["_heads"][c].alias(c) for c in ("ord", "level", "heading")], z["_up"]["above"].alias("above"), z["_up"]["place"].alias("place"), (z["_heads"]["i"] + 1).alias("at"), until(i).alias("until"), F.when(z["_heads"]["level"] > 0, z["_down"]).otherwise(i + 1).alias("last"))
    return rows.withColumn("sections", F.when(F.size("_heads") == 0, F.array().cast("array<struct<ord:int,level:int,heading:string,above:int,place:int,at:int,until:int,last:int>>")).otherwise(F.transform("_zip", section))).drop("_up", "_down", "_zip", "_heads")


def with_nodes(rows: DataFrame) -> DataFrame:
    """Adds ``every``, an array of all nodes of a page before merging; null for a page without blocks, as one that can't be parsed.

    ``rows`` are metadata rows that carry a page's blocks (with classification, if any) and linked data,
    so a page's nodes are built in its own row.  Order: the page, its sections and blocks, linked data,
    the author.
    """
    base = F.col("base")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("base", document_base(F.coalesce("final_url", "url")))
    if "classification" not in rows.schema["blocks"].dataType.elementType.names:
        rows = rows.withColumn("blocks", F.transform("blocks", lambda b: b.withField("classification", F.lit(None).cast("string"))))
    rows = rows.withColumn("tops", F.transform(F.filter("blocks", lambda b: b["depth"] == 0), lambda b: b.withField("said", block_text(lambda c: b[c]))))
    rows = with_sections(rows)
    labelled = "label" in rows.schema["blocks"].dataType.elementType.names
    own = lambda b: F.coalesce(*[b["label"]] * labelled, b["classification"], b["type"])
    rows = rows.withColumn("nodes", F.transform("tops", lambda b: F.when(b["type"] != "heading", block_node(b, F.concat_ws(":", own(b), fnv1a_expr(b["said"])), base))))
    label = lambda s: F.when(F.coalesce(s["heading"], F.lit("")) != "", fnv1a_expr(s["heading"])).otherwise("preamble")
    sid = lambda s: F.concat(base, F.lit("#section-l"), s["level"].cast("string"), F.lit("-"), label(s), F.lit("-"), s["place"].cast("string"))
    rows = rows.withColumn("sids", F.transform("sections", sid)).withColumn("ids", F.transform("nodes", lambda n: n["id"]))
    # a section's blocks stand together, and the sections below it do
    below = lambda i, s: F.filter(F.slice("_both", i + 2, s["last"] - i - 1), lambda x: x["sections"]["above"] == i)
    held = lambda i, s: F.concat(F.slice("ids", s["at"] + 1, s["until"] - s["at"]), F.transform(below(i, s), lambda x: x["sids"]))
    above = lambda s: F.coalesce(F.try_element_at("sids", s["above"] + 1), F.concat(base, F.lit("#webpage")))
    title = lambda s: quoted(F.nullif(s["heading"], F.lit("")))
    section = lambda s, i: _node(1, s["ord"], F.element_at("sids", i + 1), F.lit("WebPageElement"), _pairs(isPartOf=_ref(above(s)), name=title(s), headline=title(s), position=F.when(s["level"] > 0, s["level"].cast("string")), hasPart=_refs(F.element_at("held", i + 1))))
    rows = rows.withColumn("_both", F.arrays_zip("sections", "sids")).withColumn("held", F.transform("sections", lambda s, i: held(i, s)))
    person = F.when(F.col("author").isNotNull(), F.concat(base, F.lit("#person-"), fnv1a_expr(F.col("author"))))
    rows = rows.withColumns({"person": person, "main": main_id(F.col("linked")), "first": F.transform(F.filter("_both", lambda x: x["sections"]["above"].isNull()), lambda x: x["sids"])})
    w_pairs = _pairs(
        url=quoted(F.col("final_url")), name=quoted(F.col("title")), description=quoted(F.col("description")), inLanguage=quoted(F.col("lang")), datePublished=quoted(F.col("published_time")), dateModified=quoted(F.col("modified_time")),
        image=quoted(F.col("image")), isBasedOn=quoted(F.col("canonical")), publisher=F.concat(F.lit('{"@type":"Organization","name":'), quoted(F.col("site_name")), F.lit("}")), author=_ref(F.col("person")), mainEntity=_ref(F.col("main")), hasPart=F.when(F.size(F.coalesce("first", none)) > 0, _refs(F.col("first"))),
    )
    web = F.array(_node(0, F.lit(0), F.concat(base, F.lit("#webpage")), F.lit("WebPage"), w_pairs))
    author = F.filter(F.array(_node(3, F.lit(0), F.col("person"), F.lit("Person"), _pairs(name=quoted(F.col("author"))))), lambda n: n["id"].isNotNull())
    # sections stand before the blocks they hold
    placed = F.transform(F.concat(F.transform("sections", section), F.filter("nodes", lambda n: n["id"].isNotNull())), lambda n, i: F.struct(n["o"], i.alias("i"), n.alias("n")))
    content = F.transform(F.sort_array(placed), lambda x: x["n"])
    return rows.withColumn("every", F.concat(web, content, F.transform("linked", linked_node), author))


def _typed(n: Column) -> Column:
    """A node's properties, its type first."""
    return F.concat(F.array(F.struct(F.lit("@type").alias("prop"), quoted(n["type"]).alias("value"))), n["pairs"])


def graph_pairs(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, node_ord, id, prop, prop_ord, value, and the kept columns): all nodes of each page before merging (see ``with_nodes``).

    A page without blocks, as one that can't be parsed, has one row without an id.
    """
    flat = with_nodes(rows).select("page_id", *keep, F.posexplode_outer("every").alias("node_ord", "n"))
    pairs = flat.select("page_id", "node_ord", F.col("n.id").alias("id"), *keep, F.posexplode_outer(_typed(F.col("n"))).alias("prop_ord", "p"))
    return pairs.select("page_id", "node_ord", "id", "prop_ord", "p.prop", "p.value", *keep).filter("value IS NOT NULL OR id IS NULL")


def node_props(nodes: Column) -> Column:
    """array(id, prop, node_ord, prop_ord, value) of an array of nodes: what ``graph_pairs`` has as rows, in the page's own row."""
    of = lambda n, i: F.transform(_typed(n), lambda p, j: F.struct(n["id"].alias("id"), p["prop"].alias("prop"), i.alias("node_ord"), j.alias("prop_ord"), p["value"].alias("value")))
    return F.filter(F.flatten(F.transform(nodes, of)), lambda x: x["value"].isNotNull() & x["id"].isNotNull())


def _bound(c: Column, f) -> Column:
    """``f`` of a column that is computed once, though ``f`` names it at many places."""
    return F.element_at(F.transform(F.array(c), f), 1)


def page_document(props: Column) -> Column:
    """struct(n_nodes, document): properties of a page's nodes (see ``node_props``) merged as by ``merge_nodes`` and ``graph_documents``, without a shuffle.

    Sorting brings the properties of a node together, the first value of each in front, so no step is quadratic.
    """
    before = lambda x, i, c: F.get(x, i - 1)[c]
    member = lambda y: F.concat(quoted(y["prop"]), F.lit(":"), y["value"])

    def of_first(x):
        """Of properties by id, name and place: the first of each name, by id and place."""
        kept = F.filter(x, lambda y, i: (i == 0) | (before(x, i, "id") != y["id"]) | (before(x, i, "prop") != y["prop"]))
        return F.sort_array(F.transform(kept, lambda y: F.struct(y["id"], y["node_ord"], y["prop_ord"], member(y).alias("m"))))

    def heads(x):
        """Where each node begins."""
        return F.filter(F.transform(x, lambda y, i: F.when((i == 0) | (before(x, i, "id") != y["id"]), F.struct(y["node_ord"], i.alias("at"), y["id"]))), lambda h: h.isNotNull())

    def told(x, hs):
        said = lambda h, k: F.concat(opened(h["id"]), F.array_join(F.transform(F.slice(x, h["at"] + 1, F.coalesce(F.get(hs, k + 1)["at"], F.size(x)) - h["at"]), lambda y: y["m"]), ","), F.lit("}"))
        nodes = F.sort_array(F.transform(hs, lambda h, k: F.struct(h["node_ord"], said(h, k).alias("s"))))
        return F.when(F.size(hs) > 0, F.struct(F.size(hs).cast("long").alias("n_nodes"), document(F.transform(nodes, lambda n: n["s"])).alias("document")))

    return _bound(F.sort_array(props), lambda x: _bound(of_first(x), lambda y: _bound(heads(y), lambda hs: told(y, hs))))


def opened(id_: Column) -> Column:
    """The beginning of a node; one without an id of its own doesn't tell it."""
    return F.when(id_.startswith("_:anon"), F.lit("{")).otherwise(F.concat(F.lit('{"@id":'), quoted(id_), F.lit(",")))


def document(nodes: Column) -> Column:
    """The JSON-LD text of a page's nodes."""
    return F.concat(F.lit(f'{{"@context":{CONTEXT},"@graph":['), F.array_join(nodes, ","), F.lit("]}"))


def merge_nodes(pairs: DataFrame) -> DataFrame:
    """Of nodes with one id the first value of each property, at the place of the first."""
    order = F.struct("node_ord", "prop_ord")
    # dealt out once, by page: all that follows, to the page's document, finds its rows together
    merged = pairs.repartition("page_id").groupBy("page_id", "id", "prop").agg(F.min_by("value", order).alias("value"), F.min(order).alias("at"))
    first = Window.partitionBy("page_id", "id")
    return merged.select("page_id", F.min(F.col("at.node_ord")).over(first).alias("node_ord"), "id", "prop", F.col("at.prop_ord").alias("prop_ord"), "value", F.col("at.node_ord").alias("from_ord"))


def graph_documents(merged: DataFrame) -> DataFrame:
    """(page_id, n_nodes, document): the nodes of each page as one JSON-LD text."""
    member = F.concat(quoted(F.col("prop")), F.lit(":"), F.col("value"))
    nodes = merged.groupBy("page_id", "id", "node_ord").agg(F.array_sort(F.collect_list(F.struct("from_ord", "prop_ord", member.alias("m")))).alias("x"))
    said = F.concat(opened(F.col("id")), F.array_join(F.transform("x", lambda x: x["m"]), ","), F.lit("}"))
    rows = nodes.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_list(F.struct("node_ord", said.alias("s")))).alias("g"))
    return rows.select("page_id", "n_nodes", document(F.transform("g", lambda x: x["s"])).alias("document"))
