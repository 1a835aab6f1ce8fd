"""Blocks as a table function: a page goes in, its blocks come out row by row, with the wanted columns alone."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillmesh.sources.blocks import stream_blocks
from quillmesh.sources.emit import Style
from quillmesh.sources.html import DEEPEST, parse_html, prune, select_first
from quillmesh.sources.pages import BLOCK, read_references
from quillmesh.sources.reconstruct import space_out

_LINK = StructType().add("text", StringType()).add("href", StringType())
_TYPES = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "array<struct<text:string,href:string>>": ArrayType(_LINK), "array<string>": ArrayType(StringType()), "array<array<string>>": ArrayType(ArrayType(StringType()))}
#: the columns of a block, named without a session, as workers have none
FIELDS = StructType()
for _name, _type in (f.split(" ", 1) for f in BLOCK.split(", ")):
    FIELDS.add(_name, _TYPES[_type])


def wanted_columns(columns: str | None) -> list[str]:
    """Names of block columns from a list with commas; all of them where it is null."""
    if columns is None:
        return list(FIELDS.names)
    names = [c.strip() for c in columns.split(",") if c.strip()]
    unknown = [c for c in names if c not in FIELDS.names]
    if unknown or not names or len(set(names)) < len(names):
        raise ValueError(f"columns of blocks are {', '.join(FIELDS.names)}, each at most once; not {columns!r}")
    return names


class PageBlocks:
    """The handler of the table function: ``(html, base, columns, selector, bare)``.

    ``columns``, ``selector`` and ``bare`` are constants; the result has the named columns, in that order, and ``error``.
    ``bare`` names the references that are read without their semicolon, with commas; null stands for all, as in browsers.
    Null HTML is an empty page and has no blocks.  A page that can't be parsed gives a row that holds its error
    alone, after the blocks that were read before it.  What a page's scripts would show isn't looked for.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, base: AnalyzeArgument, columns: AnalyzeArgument = None, selector: AnalyzeArgument = None, bare: AnalyzeArgument = None) -> AnalyzeResult:
        for name, given in (("columns", columns), ("selector", selector), ("bare", bare)):
            if given is not None and not given.isConstantExpression:
                raise ValueError(f"{name} of a table function of blocks must be a constant")
        schema = StructType([FIELDS[c] for c in wanted_columns(columns.value if columns is not None else None)])
        return AnalyzeResult(schema.add("error", StringType()))

    def eval(self, html, base, columns=None, selector=None, bare=None) -> Iterator[tuple]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
        names = wanted_columns(columns)
        try:
            references = True if bare is None else tuple(n.strip() for n in bare.split(",") if n.strip())
            root = parse_html(space_out(read_references(html or "", references)))
            prune(root)
            node = (select_first(root, selector) if selector else None) or next(n for n in root.children if n.tag == "body")
            for row in stream_blocks(node, Style(base or ""), frozenset(names)):
                yield (*[row.get(c) for c in names], None)
        except Exception as e:  # a page that can't be parsed stays visible
            yield (*[None] * len(names), f"{type(e).__name__}: {e}")


def register_block_table(spark: SparkSession, name: str = "page_blocks") -> None:
    """Makes the table function known to SQL: ``SELECT ... FROM pages, LATERAL page_blocks(html, url, 'ord, type, text')``."""
    spark.udtf.register(name, F.udtf(PageBlocks, useArrow=True))


def with_block_table(pages: DataFrame, *columns: str, html: Column | None = None, base: Column | None = None, selector: str | None = None, bare: str | None = None) -> DataFrame:
    """Rows of pages joined laterally with their blocks, of which only ``columns`` are read (all, if none is named).

    A page without blocks has no row, rows that repeat a page are pages like others.  ``error`` comes last.
    Columns of pages that are called like a wanted one, or ``error``, are refused.
    """
    names = wanted_columns(",".join(columns) if columns else None)
    clash = set(pages.columns) & {*names, "error"}
    if clash:
        raise ValueError(f"columns of pages and of blocks have one name: {', '.join(sorted(clash))}")
    html, base = F.col("html") if html is None else html, F.col("url") if base is None else base
    blocks = F.udtf(PageBlocks, useArrow=True)(html.outer(), base.outer(), F.lit(",".join(names)), F.lit(selector).cast("string"), F.lit(bare).cast("string"))
    return pages.lateralJoin(blocks)
