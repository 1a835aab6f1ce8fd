"""Rule-based classification of blocks, with hints from linked data and page metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P
from quillmesh.functions.text import trimmed

#: labels of the classifier, in the order in which a marker filter may name them
LABELS = ("pricing", "date", "author", "contact", "product", "rating", "code", "table", "image", "link", "heading", "list", "paragraph")
HINT, META = 0.95, 0.9


def block_text(get=F.col) -> Column:
    """What a block says, from its columns (or, by ``get``, its fields): text, code, cells, items, link or caption."""
    cells = F.array_join(F.transform(get("rows"), lambda r: F.array_join(r, " ")), " ")
    table = F.trim(F.concat_ws(" ", F.coalesce(F.array_join(get("headers"), " "), F.lit("")), F.coalesce(cells, F.lit(""))))
    items = F.array_join(F.transform(get("items"), lambda i: F.coalesce(i["text"], F.lit(""))), " ")
    return F.coalesce(get("text"), get("code"), F.when(get("type") == "table", table), F.when(get("type") == "list", items), F.concat(F.lit(" "), get("href")), get("alt"), F.lit(""))


def label(kind: Column, t: Column) -> Column:
    """struct(type, confidence) of the first rule that holds; null for a blank text or a group.

    ``t`` is trimmed and a column of its own, since every rule reads it.
    """

    # plain searches first: the patterns look around at every letter, and few texts can match them
    digit, low = t.rlike("[0-9]"), F.lower(t)
    price, date, rating, phone = (digit & t.rlike(p) for p in (P.PRICE, P.DATE, P.RATING, P.PHONE))
    email = t.contains("@") & t.rlike(P.EMAIL)
    author = (F.length(t) < 120) & (low.contains("by") | low.contains("author")) & t.rlike(P.AUTHOR)
    product = (low.contains("product") | low.contains("sku") | low.contains("model") | low.contains("add to cart") | low.contains("buy now")) & t.rlike(P.PRODUCT)

    def is_(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"))

    return (
        F.when((t == "") | t.isNull() | kind.isNull() | (kind == "group"), F.lit(None))
        .when(kind == "code", is_("code", 1.0))
        .when((kind == "table") & price, is_("pricing", 0.7))
        .when(kind == "table", is_("table", 0.9))
        .when(kind == "image", is_("image", 1.0))
        .when(kind == "link", is_("link", 0.9))
        .when(kind == "list", is_("list", 0.8))
        .when(kind == "heading", is_("heading", 1.0))
        .when(price, is_("pricing", 0.85))
        .when(date, is_("date", 0.8))
        .when(rating, is_("rating", 0.75))
        .when(email | phone, is_("contact", 0.8))
        .when(author, is_("author", 0.6))
        .when(product, is_("product", 0.65))
        .otherwise(is_("paragraph", 0.5))
    )


def linked_hints(linked: Column) -> Column:
    """array(hint, label): names, dates and prices that a page's linked data (array of id, types, props) states, in order."""

    def of(node: Column) -> Column:
        kind = F.lower(F.coalesce(F.try_element_at(node["types"], F.lit(1)), F.lit("")))
        got = lambda *paths: F.coalesce(*[F.get_json_object(node["props"], p) for p in paths])
        said = lambda hint, name: F.struct(hint.alias("hint"), F.lit(name).alias("label"))
        return F.array(
            F.when(kind.contains("offer") | kind.contains("price"), said(got("$.price", "$.offers.price"), "pricing")),
            F.when(kind.contains("product"), said(got("$.name"), "product")),
            F.when(kind.contains("article"), said(got("$.datePublished", "$.dateModified"), "date")),
            F.when(kind.contains("article"), said(got("$.author.name"), "author")),
        )

    return F.filter(F.flatten(F.transform(linked, of)), lambda h: h["hint"].isNotNull() & (h["hint"] != ""))


def chosen(kind: Column, text: Column, rule: Column, hints: Column | None, author: Column | None, published: Column | None) -> Column:
    """struct(type, confidence) of a block.

    A block that holds a page's publication time is a date, else one that holds its author an author,
    else the first hint that it holds decides, else the rule.
    """
    said = lambda label_, confidence: F.when(label_.isNotNull(), F.struct(label_.alias("type"), F.lit(confidence).alias("confidence")))
    holds = lambda c: F.lit(False) if c is None else F.coalesce(c != "", F.lit(False)) & text.contains(c)
    best = [said(F.when(holds(published), F.lit("date")).when(holds(author), F.lit("author")), META)]
    if hints is not None:
        best.append(said(F.try_element_at(F.filter(hints, lambda h: text.contains(h["hint"])), F.lit(1))["label"], HINT))
    return F.when(kind != "group", F.coalesce(*best, rule))


def classify(blocks: DataFrame) -> DataFrame:
    """Adds classification and confidence to rows of blocks.

    Columns ``hints`` (see ``linked_hints``), ``author`` and ``published_time`` of the block's page are
    heeded where the rows carry them; nothing is joined.
    """
    own = {c: F.col(c) if c in blocks.columns else None for c in ("hints", "author", "published_time")}
    out = blocks.withColumn("_text", block_text())
    out = out.withColumn("_t", trimmed(F.col("_text")))
    out = out.withColumn("_rule", label(F.col("type"), F.col("_t")))
    best = chosen(F.col("type"), F.col("_text"), F.col("_rule"), own["hints"], own["author"], own["published_time"])
    return out.withColumn("_best", best).withColumns({"classification": F.col("_best.type"), "confidence": F.col("_best.confidence")}).drop("_text", "_t", "_rule", "_best")


def classified(blocks: Column, hints: Column | None = None, author: Column | None = None, published: Column | None = None) -> Column:
    """An array of blocks with classification and confidence, in the page's own row."""
    # what is the page's own is bound to a variable first: as plain columns, its expressions would be computed again for each block
    own = {"blocks": blocks} | {k: c for k, c in (("hints", hints), ("author", author), ("published", published)) if c is not None}

    def of_page(page: Column) -> Column:
        got = lambda k: page[k] if k in own else None
        # the text is a field of its own, since every rule reads it
        said = F.transform(page["blocks"], lambda b: b.withField("_text", block_text(lambda c: b[c])))
        said = F.transform(said, lambda b: b.withField("_t", trimmed(b["_text"])))
        said = F.transform(said, lambda b: b.withField("_best", chosen(b["type"], b["_text"], label(b["type"], b["_t"]), got("hints"), got("author"), got("published"))))
        return F.transform(said, lambda b: b.withField("classification", b["_best"]["type"]).withField("confidence", b["_best"]["confidence"]).dropFields("_text", "_t", "_best"))

    return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in own.items()])), of_page), 1)


def histogram(classified: DataFrame) -> DataFrame:
    return classified.filter("classification IS NOT NULL").groupBy("page_id", "classification").agg(F.count("*").alias("n_blocks"))


def corpus_cube(classified: DataFrame) -> DataFrame:
    """Counts by block type and classification, with all subtotals."""
    return classified.cube("type", "classification").agg(F.count("*").alias("n"))


def top_labels(classified: DataFrame, k: int = 3) -> DataFrame:
    """Each page's most frequent labels; ties by name."""
    counts = histogram(classified)
    order = Window.partitionBy("page_id").orderBy(F.desc("n_blocks"), "classification")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
