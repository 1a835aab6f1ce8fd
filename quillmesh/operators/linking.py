"""Entity linking against knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types that are linked, and properties that are told of an entity.
LINKABLE = ("Person", "Organization", "Product", "Place", "LocalBusiness", "Corporation", "Brand", "Article", "NewsArticle", "BlogPosting", "Event", "CreativeWork")
CLAIMS = ("P31", "P279", "P361", "P17", "P27", "P106", "P569", "P570", "P856", "P159", "P112", "P127", "P749", "P166", "P800")
ENTITY, PROPERTY = "http://www.wikidata.org/entity/", "http://www.wikidata.org/prop/direct/"
DEFAULT_LIMIT, MOST = 8, 15


def plain_types(c: Column) -> Column:
    return F.transform(c, lambda t: F.regexp_replace(F.regexp_replace(t, "(?i)^schema:", ""), r"(?i)^https?://schema\.org/", ""))


def qid_of(iri: Column) -> Column:
    """The entity number at an address's end, upper case; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(iri, r"(?i)(?:entity/|wiki/)(Q[0-9]+)/?$", 1)), F.lit(""))


def candidates(nodes: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(page_id, node_ord, id, label, existing_qid): at most ``limit`` (15 at the highest) of each page.

    ``nodes`` has page_id, node_ord, id, types, name, headline, pref_label, rdf_label, text and same_as
    (array).  A limit is part of this operator: a page's first candidates are looked up, in order.
    """
    long = lambda c: F.when(F.length(F.trim(c)) >= 2, F.trim(c))
    text = F.col("text")
    label = F.coalesce(*[long(F.col(c)) for c in ("name", "headline", "pref_label", "rdf_label")], F.when(F.length(text).between(3, 120), F.trim(text)))
    types = plain_types(F.coalesce(F.col("types"), F.array().cast("array<string>")))
    fit = F.arrays_overlap(types, F.array(*map(F.lit, LINKABLE))) | (F.size(types) == 0) | F.array_contains(types, "WebPageElement")
    qids = F.array_compact(F.transform(F.coalesce(F.col("same_as"), F.array().cast("array<string>")), qid_of))
    rows = nodes.withColumns({"label": label, "existing_qid": F.try_element_at(qids, F.lit(1))})
    rows = rows.filter(F.col("id").isNotNull() & ~F.col("id").contains("wikidata.org/entity/") & F.col("label").isNotNull() & fit)
    once = Window.partitionBy("page_id", "id", "label").orderBy("node_ord")
    order = Window.partitionBy("page_id").orderBy("node_ord")
    rows = rows.withColumn("_k", F.row_number().over(once)).filter("_k = 1").withColumn("_r", F.row_number().over(order))
    return rows.filter(F.col("_r") <= min(limit, MOST)).select("page_id", "node_ord", "id", "label", "existing_qid")


def resolve(found: DataFrame, kb_labels: DataFrame) -> DataFrame:
    """(page_id, id, qid, label, confidence) of candidates that are linked.

    ``kb_labels`` has search_label, rank, qid, label and match_type: what a search for the label gives.
    A known number is exact; else the first hit counts if its label equals, holds or is held by the
    candidate's (exact), or if its own match is on a label (high).
    """
    first = Window.partitionBy("search_label").orderBy("rank", "qid")
    top = kb_labels.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(F.col("search_label").alias("_l"), F.col("qid").alias("hit"), F.col("label").alias("hit_label"), "match_type")
    rows = found.join(top, (F.col("label") == F.col("_l")) & (F.length("label") >= 2) & F.col("existing_qid").isNull(), "left")
    a, b = F.lower(F.trim("label")), F.lower(F.trim(F.coalesce("hit_label", "label")))
    exact = a.contains(b) | b.contains(a)
    score = F.when(F.col("match_type") == "label", 1.0).otherwise(0.7)
    confidence = F.when(F.col("existing_qid").isNotNull(), "exact").when(F.col("hit").isNull(), None).when(exact, "exact").when(score >= 0.9, "high")
    out = rows.select("page_id", "id", F.coalesce("existing_qid", "hit").alias("qid"), F.when(F.col("existing_qid").isNull(), F.coalesce("hit_label", "label")).alias("label"), confidence.alias("confidence"))
    return out.filter("confidence IS NOT NULL")


def attach(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds the entity's address to same_as, once, and a name where there is none."""
    last = Window.partitionBy("page_id", "id").orderBy(F.desc("qid"))
    one = links.withColumn("_k", F.row_number().over(last)).filter("_k = 1").select("page_id", "id", F.col("qid").alias("_q"), F.col("label").alias("_n"))
    rows = nodes.join(one, ["page_id", "id"], "left")
    own = F.coalesce("same_as", F.array().cast("array<string>"))
    iri = F.concat(F.lit(ENTITY), F.col("_q"))
    same = F.when(F.col("_q").isNull(), F.col("same_as")).otherwise(F.when(F.array_contains(own, iri), own).otherwise(F.array_append(own, iri)))
    return rows.withColumns({"same_as": same, "name": F.coalesce(F.nullif(F.col("name"), F.lit("")), "_n")}).drop("_q", "_n")


def claim_value(kind: Column, value: Column) -> Column:
    """A claim's value as text (an entity as its address); null where none is told."""
    get = lambda p: F.get_json_object(value, p)
    time = get("$.time")
    return (
        F.when(kind == "wikibase-entityid", F.concat(F.lit(ENTITY), F.nullif(get("$.id"), F.lit(""))))
        .when(kind.isin("string", "external-id"), F.regexp_replace(value, r'^"(.*)"$', "$1"))
        .when(kind == "time", F.when(time.startswith("+"), F.substring(time, 2, 10)).otherwise(F.substring(time, 1, 10)))
        .when(kind == "monolingualtext", get("$.text"))
        .when(kind == "quantity", F.regexp_replace(get("$.amount"), r"^\+", ""))
    )


def entity_nodes(links: DataFrame, kb_entities: DataFrame, lang: str = "en", most: int = 3) -> DataFrame:
    """(id, label, definition, claims): a node for each linked entity.

    ``kb_entities`` has qid, labels and descriptions (maps) and claims (array of property, rank, type,
    value).  Of each property that is told, the first ``most`` statements.
    """
    wanted = links.select("qid").distinct()
    rows = kb_entities.join(wanted, "qid", "left_semi")
    said = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(lang)), F.try_element_at(F.map_values(c), F.lit(1)))
    told = F.filter(F.transform(F.array(*map(F.lit, CLAIMS)), lambda p: F.struct(F.concat(F.lit("wdt:"), p).alias("prop"), F.filter(F.transform(F.slice(F.filter("claims", lambda c: c["property"] == p), 1, most), lambda c: claim_value(c["type"], c["value"])), lambda v: v.isNotNull()).alias("values"))), lambda x: F.size(x["values"]) > 0)
    return rows.select(F.concat(F.lit(ENTITY), F.col("qid")).alias("id"), said("labels").alias("label"), said("descriptions").alias("definition"), told.alias("claims"))


def with_entities(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities (page_id, id) that their page has no node of."""
    return entities.join(nodes.select("page_id", "id").distinct(), ["page_id", "id"], "left_anti")
