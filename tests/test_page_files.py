"""The page data source: equal to the Parquet scan, whole or nothing, and skipping by url."""

import os

import pytest
from pyspark.sql import functions as F

from quillmesh.sources.page_files import PageReader, committed, opened, read_page_files, write_page_files
from quillmesh.sources.pages import load_pages


def _pages(spark, data):
    return load_pages(spark, data).select("page_id", "url", "html")


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_equals_the_parquet_scan_and_appends(spark, data, tmp_path):
    pages, path = _pages(spark, data), str(tmp_path / "a")
    write_page_files(pages.filter("page_id % 2 = 0"), path, files=3)
    write_page_files(pages.filter("page_id % 2 = 1"), path, files=2)
    assert _rows(read_page_files(spark, path)) == _rows(pages)
    assert read_page_files(spark, path, "url string").columns == ["url"]
    assert read_page_files(spark, f"file://{path}").count() == pages.count()


def test_overwrite_and_empty_tables(spark, data, tmp_path):
    pages, path = _pages(spark, data), str(tmp_path / "b")
    with pytest.raises(Exception, match="no pages were written"):
        read_page_files(spark, path).count()
    write_page_files(pages, path)
    write_page_files(pages.limit(3), path, "overwrite")
    assert read_page_files(spark, path).count() == 3
    write_page_files(pages.limit(0), path)
    assert read_page_files(spark, path).count() == 3
    with pytest.raises(ValueError, match="need a url"):
        write_page_files(pages.drop("url"), path)


def test_a_failed_task_leaves_no_half_file(spark, data, tmp_path):
    pages, path = _pages(spark, data), str(tmp_path / "c")
    write_page_files(pages, path, files=2)
    before = sorted(os.listdir(path))
    bad = pages.withColumn("html", F.when(F.col("page_id") == 7, F.raise_error(F.lit("broken page")).cast("string")).otherwise(F.col("html")))
    with pytest.raises(Exception, match="broken page"):
        bad.write.format("quill_pages").option("path", path).mode("append").save()
    assert _rows(read_page_files(spark, path)) == _rows(pages)
    assert sorted(os.listdir(path)) == before and os.listdir(f"{path}/_staging") == []


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    rows = [(1, "https://a.org/", None, [1, 2]), (1, "https://a.org/", None, [1, 2]), (None, None, "<p>x</p>", None), (2, "", "", [])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, more array<int>")
    write_page_files(frame, str(tmp_path / "d"), files=2)
    assert _rows(read_page_files(spark, str(tmp_path / "d"))) == _rows(frame)


def test_filters_on_the_url_reach_the_files(spark, data, tmp_path):
    pages, path = _pages(spark, data), str(tmp_path / "e")
    write_page_files(pages, path, files=5)
    some = sorted(r["url"] for r in pages.select("url").collect())[10]
    site = some[: some.index("/", 8) + 1]
    for cond in (F.col("url").startswith(site), F.col("url") == some, F.col("url").isin(some, "x", None), F.col("url").startswith("zzz"), F.col("url").isNull(), F.col("url").startswith(site) & (F.col("page_id") > 3)):
        assert _rows(read_page_files(spark, path).filter(cond)) == _rows(pages.filter(cond))
    assert "BatchScan" in read_page_files(spark, path).filter(F.col("url") == some)._jdf.queryExecution().executedPlan().toString()
    reader = PageReader(path, None)
    every = sum(len(p.parts) for p in reader.partitions())
    reader.prefixes, reader.exact = [(site,)], [False]
    assert every == len(committed(path)) and 0 < sum(len(p.parts) for p in reader.partitions()) < every


def test_bounds_of_groups():
    reader = PageReader("", None)
    reader.prefixes, reader.exact = [("b/",)], [False]
    assert reader._may_hold("a/x", "b/a") and reader._may_hold("b/x", "c") and not reader._may_hold("c", "d") and not reader._may_hold("a", "b")
    assert reader._may_hold(None, None) and opened("file:///tmp")[1] == "/tmp"
