"""Blocks of markdown texts, line by line, by windows.

Fences are told by the parity of a running count, list runs by gaps and islands.  Everything is
partitioned by document, so a window sorts one document's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import trimmed

_LINK = r"^\[([^\]]+)\]\(([^)]+)\)$"
_IMAGE = r"^!\[([^\]]*)\]\(([^)]+)\)$"
_BULLET, _NUMBER = r"^\s*[-*+]\s+(.*)$", r"^\s*\d+\.\s+(.*)$"


def markdown_blocks(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, type, level, text, href, src, alt, language, code, ordered, items); a fence never closed is lost."""
    lines = frame.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))
    t = trimmed(F.col("line"))
    by = Window.partitionBy("id").orderBy("n")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"t": t, "fence": t.startswith("```")})
    lines = lines.withColumn("fences", F.sum(F.col("fence").cast("int")).over(upto))
    lines = lines.withColumn("in_code", (F.col("fences") % 2 == 1) & ~F.col("fence"))
    code = (
        lines.filter("in_code OR fence").withColumn("pair", F.floor((F.col("fences") + F.when(F.col("fence") & (F.col("fences") % 2 == 0), -1).otherwise(0)) / 2))
        .groupBy("id", "pair")
        .agg(
            F.min(F.when(F.col("fence"), F.col("n"))).alias("open"), F.max(F.when(F.col("fence"), F.col("n"))).alias("n"), F.count_if("fence").alias("ends"),
            F.min_by(F.col("t"), F.col("n")).alias("first"), F.array_sort(F.collect_list(F.when(F.col("in_code"), F.struct("n", "line")))).alias("held"),
        )
        .filter("ends = 2")
        .select("id", "n", F.lit("code").alias("type"), trimmed(F.substring("first", 4, 1 << 30)).alias("language"), F.array_join(F.transform("held", lambda x: x["line"]), "\n").alias("code"))
    )
    plain = lines.filter("NOT in_code AND NOT fence")
    head = F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 1)
    kind = (
        F.when(F.col("t") == "", "blank").when(head != "", "heading").when(F.col("t").startswith(">"), "blockquote").when(F.col("t").rlike(_IMAGE), "image").when(F.col("t").rlike(_LINK), "link")
        .when(F.col("line").rlike(_BULLET), "bullet").when(F.col("line").rlike(_NUMBER), "number").otherwise("paragraph")
    )
    # a list run ends at any other line (fences and code included) or when its kind switches
    marked = lines.withColumn("kind", F.when(F.col("in_code") | F.col("fence"), "code").otherwise(kind))
    run = F.when(F.col("kind").isin("bullet", "number"), F.col("kind"))
    marked = marked.withColumn("island", F.sum(F.when(run.isNull() | ~run.eqNullSafe(F.lag(run).over(by)), 1).otherwise(0)).over(upto))
    item = trimmed(F.coalesce(F.nullif(F.regexp_extract("line", _BULLET, 1), F.lit("")), F.regexp_extract("line", _NUMBER, 1)))
    items = marked.filter("kind IN ('bullet', 'number')").withColumn("item", item)
    as_link = F.col("item").rlike(_LINK)
    entry = F.struct(F.when(as_link, trimmed(F.regexp_extract("item", _LINK, 1))).otherwise(F.col("item")).alias("text"), F.when(as_link, trimmed(F.regexp_extract("item", _LINK, 2))).alias("href"))
    lists = items.groupBy("id", "island").agg(F.min("n").alias("n"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))).alias("held")).select("id", "n", F.lit("list").alias("type"), (F.col("kind") == "number").alias("ordered"), F.transform("held", lambda x: x["e"]).alias("items"))
    rest = plain.withColumn("type", kind).filter("type NOT IN ('blank', 'bullet', 'number')")
    single = rest.select(
        "id", "n", "type",
        F.when(F.col("type") == "heading", F.length(head)).alias("level"),
        F.when(F.col("type") == "heading", trimmed(F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 2)))
        .when(F.col("type") == "blockquote", trimmed(F.substring("t", 2, 1 << 30)))
        .when(F.col("type") == "link", trimmed(F.regexp_extract("t", _LINK, 1)))
        .when(F.col("type") == "paragraph", F.col("t")).alias("text"),
        F.when(F.col("type") == "link", trimmed(F.regexp_extract("t", _LINK, 2))).alias("href"),
        F.when(F.col("type") == "image", trimmed(F.regexp_extract("t", _IMAGE, 2))).alias("src"),
        F.when(F.col("type") == "image", trimmed(F.regexp_extract("t", _IMAGE, 1))).alias("alt"),
    )
    every = single.unionByName(code, allowMissingColumns=True).unionByName(lists, allowMissingColumns=True)
    out = every.withColumn("ord", F.row_number().over(by) - 1)
    return out.select("id", "ord", "type", "level", "text", "href", "src", "alt", "language", "code", "ordered", "items")
