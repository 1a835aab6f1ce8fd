"""JSON-LD graphs of pages, linked to a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import classify as C
from quillmesh.operators import graph as K
from quillmesh.operators import linking as L
from quillmesh.operators.settling import settled
from quillmesh.plans.options import GraphOptions, ReadOptions
from quillmesh.plans.read import _others, content_rows, described
from quillmesh.sources.pages import ParseOptions, is_html, with_fetch_columns

#: places of properties and nodes that linking adds, after all others
_LATER, _LAST = 1 << 20, 1 << 30


def build_graph(pages: DataFrame, options: GraphOptions = GraphOptions(), kb_labels: DataFrame | None = None, kb_entities: DataFrame | None = None, resources: DataFrame | None = None, rendered: DataFrame | None = None) -> DataFrame:
    """(page_id, n_nodes, document, n_linked, engine, error) for every HTML page, as JSON-LD.

    Nodes are merged by id, linked to the knowledge base, joined by the linked entities, and merged
    again.  Rows that are equal in page_id, url and HTML are one page; a null page_id is one like others.
    A page that can't be parsed has its error and no document.  Pages are parsed once: without linking their nodes
    meet once, by page; else these, slim rows, are settled, and all that linking asks of them is read from these.
    """
    page = F.struct("page_id", F.md5(F.concat_ws("\n", "url", F.coalesce("html", F.lit("")))).alias("h"))
    rows = graph_rows(with_fetch_columns(pages).withColumn("page_id", page), options, resources, rendered)
    links = None
    if not (options.link_entities and kb_labels is not None and options.limit):
        told = K.with_nodes(rows).groupBy("page_id").agg(F.max("engine").alias("engine"), F.max("error").alias("error"), F.flatten(F.collect_list(K.node_props(F.col("every")))).alias("props"))
        out = told.withColumn("x", K.page_document(F.col("props"))).select("page_id", "engine", "error", "x.n_nodes", "x.document")
    else:
        pairs = settled(K.graph_pairs(rows, ("engine", "error")))
        told = pairs.groupBy("page_id").agg(F.max("engine").alias("engine"), F.max("error").alias("error"))
        merged = settled(K.merge_nodes(pairs.filter("id IS NOT NULL")))
        nodes = node_rows(merged)
        links = L.resolve(L.candidates(nodes, options.limit), kb_labels)
        merged = with_links(merged, nodes, links)
        if options.claims and kb_entities is not None:
            merged = merged.unionByName(entity_pairs(merged, links, kb_entities, options.lang or "en"))
        merged = K.merge_nodes(merged)
        # never broadcast: Spark guesses the size of documents from that of the tables that pages are made of
        out = told.join(K.graph_documents(merged).hint("merge"), "page_id", "left")
        out = out.join(links.groupBy("page_id").agg(F.count("*").alias("n_linked")).hint("merge"), "page_id", "left")
    counts = [F.coalesce(F.col(c) if c in out.columns else F.lit(None), F.lit(0).cast("long")).alias(c) for c in ("n_nodes", "n_linked")]
    return out.select(F.col("page_id.page_id").alias("page_id"), counts[0], "document", counts[1], "engine", "error")


def graph_rows(pages: DataFrame, options: GraphOptions, resources: DataFrame | None, rendered: DataFrame | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata rows with all that nodes are made of."""
    rows = described(content_rows(pages, ParseOptions(options.selector, bare_references=options.bare_references), ("facts", "linked", "blocks"), resources, rendered, keep), "blocks", "linked", "error", *keep)
    if options.classify:
        rows = rows.withColumn("hints", C.linked_hints(F.col("linked"))).withColumn("blocks", C.classified(F.col("blocks"), F.col("hints"), F.col("author"), F.col("published_time")))
    elif options.labelled_ids:
        rows = rows.withColumn("blocks", F.transform(C.classified(F.col("blocks")), lambda b: b.withField("label", b["classification"]).dropFields("classification", "confidence")))
    return rows


def graph_bodies(pages: DataFrame, options: ReadOptions, resources: DataFrame | None = None, rendered: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reads in format graph: a row for each page, its body the graph, without a knowledge base; a page stays one row, so nothing is joined to it."""
    given = with_fetch_columns(pages)
    rows = graph_rows(given, GraphOptions(link_entities=False, selector=options.selector, classify=options.classify or bool(options.marker), bare_references=options.bare_references), resources, rendered, keep)
    own = K.page_document(K.node_props(F.col("every")))["document"]
    done = K.with_nodes(rows).select("page_id", "final_url", "status", F.coalesce("redirects", F.array().cast("array<string>")).alias("redirects"), "engine", F.lit("graph").alias("format"), own.alias("body"), "error", *keep)
    return done.unionByName(_others(given, "graph", keep))


def node_rows(merged: DataFrame) -> DataFrame:
    """Merged properties as one row a node, for entity linking."""
    text = lambda p: F.max(F.when((F.col("prop") == p) & F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")))
    many = lambda p: F.max(F.when(F.col("prop") == p, F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")))))
    return merged.groupBy("page_id", "node_ord", "id").agg(many("@type").alias("types"), text("name").alias("name"), text("headline").alias("headline"), text("skos:prefLabel").alias("pref_label"), text("rdfs:label").alias("rdf_label"), text("text").alias("text"), many("sameAs").alias("same_as"))


def with_links(merged: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The properties with each linked node's entity in sameAs, once, and a name where there was none."""
    found = L.attach(nodes.join(links.select("page_id", "id").distinct(), ["page_id", "id"], "left_semi"), links)
    new = found.select("page_id", "id", F.col("node_ord").alias("_o"), K.json_values(F.col("same_as")).alias("_same"), K.quoted(F.col("name")).alias("_name"))
    kept = merged.join(new.drop("_o"), ["page_id", "id"], "left")
    kept = kept.withColumn("value", F.when(F.col("prop") == "sameAs", F.coalesce("_same", "value")).when((F.col("prop") == "name") & (F.col("value") == '""'), F.coalesce("_name", "value")).otherwise(F.col("value")))
    # a node that has the property keeps it: in merging the first place wins
    more = new.select("page_id", F.col("_o").alias("node_ord"), "id", F.posexplode(F.array(F.struct(F.lit("sameAs").alias("prop"), F.col("_same").alias("value")), F.struct(F.lit("name").alias("prop"), F.col("_name").alias("value")))).alias("k", "p"))
    more = more.select("page_id", "node_ord", "id", "p.prop", (F.col("k") + _LATER).alias("prop_ord"), "p.value", F.col("node_ord").alias("from_ord")).filter("value IS NOT NULL")
    return kept.drop("_same", "_name").unionByName(more)


def entity_pairs(merged: DataFrame, links: DataFrame, kb_entities: DataFrame, lang: str) -> DataFrame:
    """The properties of the entities that a page links to and has no node of."""
    told = L.entity_nodes(links, kb_entities, lang)
    asked = links.select("page_id", F.concat(F.lit(L.ENTITY), "qid").alias("id")).distinct()
    rows = L.with_entities(merged.select("page_id", "id"), asked).join(told, "id")
    order = F.dense_rank().over(Window.partitionBy("page_id").orderBy("id"))
    said = lambda name, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("prop"), F.array(c).alias("values")))
    props = F.concat(F.array_compact(F.array(said("rdfs:label", "label"), said("skos:prefLabel", "label"), said("skos:definition", "definition"))), "claims")
    rows = rows.withColumn("node_ord", order + _LAST).select("page_id", "id", "node_ord", F.posexplode(props).alias("prop_ord", "p"))
    return rows.select("page_id", F.col("node_ord").cast("int").alias("node_ord"), "id", "p.prop", "prop_ord", K.json_values(F.col("p.values")).alias("value"), F.col("node_ord").cast("int").alias("from_ord"))
