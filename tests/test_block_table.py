"""Blocks by the table function against those of the parse stage, and what it reads."""

import pytest
from pyspark.sql import functions as F

from quillmesh.sources.block_table import PageBlocks, register_block_table, with_block_table
from quillmesh.sources.blocks import block_rows, stream_blocks
from quillmesh.sources.emit import Style
from quillmesh.sources.html import parse_html
from quillmesh.sources.pages import load_pages, page_blocks

MIXED = '<body><div><section></section><div><p></p></div></div><h1>A</h1><div id="d"><div class="e"><p>x</p></div><ul><li>one</li><li><a href="/u">two</a></li></ul></div>loose<h2>B</h2><table><tr><th>h</th></tr><tr><td>1</td></tr></table><p><a href="/l">go</a></p></body>'


def _rows(frame):
    return sorted(str(r.asDict(True)) for r in frame.collect())


def test_equals_the_parse_stage(spark, data):
    pages = load_pages(spark, data).select("page_id", "url", "html")
    mine = with_block_table(pages).drop("html", "error")
    theirs = page_blocks(load_pages(spark, data))
    assert mine.columns == theirs.columns
    assert _rows(mine) == _rows(theirs)


def test_every_kind_and_nested_values(spark):
    pages = spark.createDataFrame([(1, "https://x.org/a/", MIXED), (1, "https://x.org/a/", MIXED), (2, None, None), (None, "https://x.org", "<p>q</p>"), (3, "https://x.org", "")], "page_id long, url string, html string")
    assert _rows(with_block_table(pages).drop("html", "error")) == _rows(page_blocks(pages.withColumns({"final_url": F.col("url"), "status": F.lit(200), "content_type": F.lit("text/html"), "redirects": F.array().cast("array<string>")})))
    items = with_block_table(pages, "type", "items").filter("type = 'list'").collect()
    assert [[tuple(i) for i in r["items"]] for r in items] == [[("one", None), ("two", "https://x.org/u")]] * 2


def test_in_sql_with_chosen_columns_and_a_selector(spark):
    register_block_table(spark, "blocks_of")
    spark.createDataFrame([(1, "https://x.org/", MIXED)], "page_id long, url string, html string").createOrReplaceTempView("mixed_pages")
    out = spark.sql("SELECT page_id, b.* FROM mixed_pages, LATERAL blocks_of(html, url, 'href_url, type', '#d') AS b")
    assert out.columns == ["page_id", "href_url", "type", "error"]
    assert [r["type"] for r in out.collect()] == ["group", "paragraph", "list"]
    with pytest.raises(Exception, match="columns of blocks are"):
        spark.sql("SELECT b.* FROM mixed_pages, LATERAL blocks_of(html, url, 'nothing') AS b").collect()
    with pytest.raises(Exception, match="must be a constant"):
        spark.sql("SELECT b.* FROM mixed_pages, LATERAL blocks_of(html, url, url) AS b").collect()


def test_a_page_that_fails_shows_its_error():
    rows = list(PageBlocks().eval(7, "https://x.org/", "ord,text"))
    assert rows[0][:2] == (None, None) and "Error" in rows[0][2] and len(rows) == 1


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="one name"):
        with_block_table(spark.createDataFrame([("x", "u", "h")], "type string, url string, html string"))


def test_rows_stream_and_unwanted_parts_are_not_read(monkeypatch):
    from quillmesh.sources import blocks

    root = next(n for n in parse_html(MIXED).children if n.tag == "body")
    calls = []
    monkeypatch.setattr(blocks, "own_rows", lambda node: calls.append(node) or [])
    first = next(stream_blocks(root, Style("https://x.org/"), frozenset({"type"})))
    assert first["type"] == "heading" and first["ord"] == 0
    assert "table" in [r["type"] for r in stream_blocks(root, Style(""), frozenset({"type"}))] and not calls
    assert len(block_rows(root, Style(""))) == len(list(stream_blocks(root, Style("")))) and calls


def test_only_wanted_columns_leave_python(spark, data):
    plan = with_block_table(load_pages(spark, data).select("page_id", "url", "html"), "type").select("page_id", "type")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan or "ArrowEvalPythonUDTF" in plan
    assert "section_ord" not in plan and "Join" not in plan
