"""Section trees over flat blocks, by windows instead of a stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_tree(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, section_ord, parent_ord, level, heading, sibling_index) of top-level headings.

    A heading's parent is the nearest earlier heading of a smaller level.  Blocks before any heading
    make one section without a heading, of level 0 and ord -1.
    """
    top = blocks.filter("depth = 0")
    heads = top.filter("type = 'heading'").select(page, "ord", "level", F.col("text").alias("heading"))
    before = Window.partitionBy(page).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(before) for k in range(1, 7)}
    marked = heads.withColumns({f"_l{k}": c for k, c in last.items()})
    nearest = None
    for k in range(1, 7):
        own = F.when(F.col("level") > k, F.col(f"_l{k}"))
        nearest = own if nearest is None else F.greatest(nearest, own)
    sections = marked.select(page, F.col("ord").alias("section_ord"), nearest.alias("parent_ord"), "level", "heading")
    first = Window.partitionBy(page)
    loose = top.withColumn("_h", F.min(F.when(F.col("type") == "heading", F.col("ord"))).over(first)).filter("type <> 'heading' AND (_h IS NULL OR ord < _h)")
    kind = blocks.schema["ord"].dataType
    preamble = loose.select(page).distinct().select(page, F.lit(-1).cast(kind).alias("section_ord"), F.lit(None).cast(kind).alias("parent_ord"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("heading"))
    every = sections.unionByName(preamble)
    siblings = Window.partitionBy(page, "parent_ord").orderBy("section_ord")
    return every.withColumn("sibling_index", F.row_number().over(siblings) - 1)


def with_section(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """Adds section_ord, the section that each block belongs to (-1 before any heading); a group's blocks go with it."""
    w = Window.partitionBy(page).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when((F.col("type") == "heading") & (F.col("depth") == 0), F.col("ord"))
    return blocks.withColumn("section_ord", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(-1)))


def flat_blocks(blocks: Column) -> Column:
    """An array of blocks as a snapshot holds them; see ``flattened``."""
    return F.filter(blocks, lambda b: (b["type"] != "group") & ~((b["type"] == "heading") & (b["depth"] == 0)))


def flattened(blocks: DataFrame) -> DataFrame:
    """The blocks that a snapshot holds: no groups, and no headings of sections (those inside groups stay)."""
    return blocks.filter("type <> 'group' AND NOT (type = 'heading' AND depth = 0)")
