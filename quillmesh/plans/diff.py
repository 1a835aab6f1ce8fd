"""Changes between pages, and between pages and the snapshots that are kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import diff as D
from quillmesh.operators.classify import classify
from quillmesh.operators.sections import flattened
from quillmesh.plans.options import DiffOptions, ReadOptions
from quillmesh.plans.read import content_rows
from quillmesh.sources.pages import ParseOptions, exploded


def _blocks(pages: DataFrame, selector: str | None, classified: bool, resources: DataFrame | None, rendered: DataFrame | None) -> DataFrame:
    """A page's snapshot blocks with key and content, as rows."""
    rows = flattened(exploded(content_rows(pages, ParseOptions(selector), ("blocks",), resources, rendered)))
    return D.keyed(classify(rows) if classified else rows)


def _bodies(found: DataFrame, options: DiffOptions, previous_at: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    if options.output == "unified":
        return D.unified(found, previous_at=previous_at, current_at=now)
    shown = F.when(F.col("change") != "unchanged", F.struct("change_ord", F.to_json(F.struct(F.col("change").alias("type"), "classification", "before", "after")).alias("j")))
    rows = found.groupBy("url").agg(F.array_sort(F.collect_list(shown)).alias("x"), *[F.count_if(F.col("change") == k).alias(k) for k in D.KINDS])
    return rows.select("url", F.concat(F.lit('{"summary":'), F.to_json(F.struct(*D.KINDS)), F.lit(',"changes":['), F.array_join(F.transform("x", lambda x: x["j"]), ","), F.lit("]}")).alias("body"))


def diff_pages(previous: DataFrame, current: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """(url, body) with the changes from one table of pages to another, joined by url."""
    return _bodies(D.changes(*[_blocks(p, options.selector, options.classify, None, None) for p in (previous, current)]), options)


def track_pages(pages: DataFrame, snapshots: DataFrame | None, now: Column, options: ReadOptions = ReadOptions(track=True), resources: DataFrame | None = None, rendered: DataFrame | None = None) -> DataFrame:
    """The table of snapshots after a read: with ``track`` those of the pages replace older ones, else it stays as it is.

    ``snapshots`` is a table as this returns it, or None for none yet.
    """
    if not options.track:
        if snapshots is None:
            raise ValueError("nothing is tracked and there are no snapshots")
        return snapshots
    new = D.snapshots(_blocks(pages, options.selector, options.classify or bool(options.marker), resources, rendered), now)
    return new if snapshots is None else D.upsert_snapshots(snapshots, new)


def diff_stored(pages: DataFrame, snapshots: DataFrame, now: Column, options: DiffOptions = DiffOptions(), resources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((url, body) of pages against their live snapshots, the table of snapshots afterwards).

    A page without a live snapshot has all its blocks added.  With ``update`` the pages' own snapshots
    replace the old ones.
    """
    current = _blocks(pages, options.selector, options.classify, resources, None)
    live = D.live_snapshots(snapshots, now)
    urls = pages.select("url").distinct()
    kept = live.join(urls, "url", "left_semi")
    found = D.changes(D.stored_blocks(kept), current)
    bodies = _bodies(found, options, kept.select("url", "fetched_at"), now)
    return bodies, (D.upsert_snapshots(snapshots, D.snapshots(current, now)) if options.update else snapshots)
