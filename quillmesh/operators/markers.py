"""Marker filters, marker ids, marked markdown and its parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.hashing import fnv1a, fnv1a_expr
from quillmesh.functions.text import trimmed
from quillmesh.operators.classify import LABELS, block_text

#: the word that opens our markers
MARK = "QUILL"


def marker_filter(value) -> list[str] | None:
    """Labels named by a string with commas or a list; unknown ones are passed over, none at all is None."""
    if value is None:
        return None
    parts = [p for v in (value if isinstance(value, (list, tuple)) else [value]) for p in str(v).split(",")]
    known = list(dict.fromkeys(p.strip().lower() for p in parts if p.strip().lower() in LABELS))
    return known or None


def marker_id(kind: Column, text: Column) -> Column:
    return fnv1a(F.concat(kind, F.lit(":"), text))


def assign_markers(classified: DataFrame, labels: list[str]) -> DataFrame:
    """Adds marker (label-id) to blocks whose label is wanted."""
    wanted = F.col("classification").isin(labels)
    return classified.withColumn("marker", F.when(wanted, F.concat_ws("-", F.lit(MARK), "classification", marker_id(F.col("classification"), block_text()))))


def wrapped(md: Column, kind: Column, id_: Column) -> Column:
    return F.concat(F.lit(f"<!-- {MARK}:"), kind, F.lit(":"), id_, F.lit(" -->\n"), md, F.lit(f"\n<!-- /{MARK}:"), kind, F.lit(":"), id_, F.lit(" -->"))


def block_markdown(get=F.col) -> Column:
    """A block's markdown from its columns (or, by ``get``, its fields)."""
    text = F.coalesce(get("text"), F.lit(""))
    said = lambda c: F.coalesce(get(c), F.lit(""))
    item = lambda x, i: F.concat(F.when(get("ordered"), F.concat((i + 1).cast("string"), F.lit("."))).otherwise(F.lit("-")), F.lit(" "), F.when(x["href"].isNull(), x["text"]).otherwise(F.concat(F.lit("["), F.coalesce(x["text"], F.lit("")), F.lit("]("), x["href"], F.lit(")"))))
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.array(row(get("headers")), row(F.transform(get("headers"), lambda _: F.lit("---")))), F.transform(get("rows"), row)), "\n")
    return (
        F.when(get("type") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(get("level"), F.lit(1))), F.lit(" "), text))
        .when(get("type") == "code", F.concat(F.lit("```"), said("language"), F.lit("\n"), said("code"), F.lit("\n```")))
        .when(get("type") == "blockquote", F.concat(F.lit("> "), text))
        .when(get("type") == "image", F.concat(F.lit("!["), said("alt"), F.lit("]("), said("src"), F.lit(")")))
        .when(get("type") == "link", F.concat(F.lit("["), text, F.lit("]("), said("href"), F.lit(")")))
        .when(get("type") == "list", F.array_join(F.transform(get("items"), item), "\n"))
        .when((get("type") == "table") & (F.size(get("headers")) > 0), table)
        .when(get("type") == "table", F.lit(""))
        .otherwise(text)
    )


def marked(classified: Column, labels: list[str]) -> Column:
    """An array of classified blocks with marker (word-label-id) where the label is wanted."""
    key = lambda b: fnv1a_expr(F.concat(b["classification"], F.lit(":"), block_text(lambda c: b[c])))
    return F.transform(classified, lambda b: b.withField("marker", F.when(b["classification"].isin(labels), F.concat_ws("-", F.lit(MARK), b["classification"], key(b)))))


def marked_markdown(marked_blocks: Column) -> Column:
    """The text of an array of marked blocks: in order, wanted ones between marker comments, blanks left out."""

    def said(b: Column) -> Column:
        md = block_markdown(lambda c: b[c])
        return F.when(trimmed(md) == "", None).when(b["marker"].isNotNull(), wrapped(md, b["classification"], F.element_at(F.split(b["marker"], "-"), -1))).otherwise(md)

    return F.array_join(F.array_compact(F.transform(F.filter(marked_blocks, lambda b: b["type"] != "group"), said)), "\n\n")


def parse_markers(frame: DataFrame, text_col: str) -> DataFrame:
    """One row for each marked stretch, with ord, marker_type, marker_id and content."""
    pattern = rf"(?s)<!-- {MARK}:([a-z]+):([a-z0-9]+) -->(.*?)<!-- /{MARK}:\1:\2 -->"
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "t"), (2, "i"), (3, "c"))])
    rows = frame.select("*", F.posexplode(parts).alias("marker_ord", "_x"))
    return rows.withColumns({"marker_type": F.col("_x.t"), "marker_id": F.col("_x.i"), "content": trimmed(F.col("_x.c"))}).drop("_x")
