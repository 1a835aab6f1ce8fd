"""Changes of pages as they arrive: a stream of fetches against the latest snapshot of each url."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.hashing import content_hash
from quillmesh.functions.text import text_content
from quillmesh.operators.diff import SNAPSHOT_DAYS

PAGES = "page_id long, url string, html string"
_OUT = "url string, fetched_at timestamp, change string, content_hash string"
_STATE = "content_hash string, fetched_at timestamp"


def read_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Pages that appear as Parquet files under a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def fetch_hashes(pages: DataFrame, fetched_at=None) -> DataFrame:
    """(url, content_hash, fetched_at) of each page's text."""
    at = F.current_timestamp() if fetched_at is None else fetched_at
    return pages.select("url", content_hash(text_content(F.col("html"))).alias("content_hash"), at.alias("fetched_at"))


def change_stream(fetches: DataFrame, days: int = SNAPSHOT_DAYS, late: str = "1 hour") -> DataFrame:
    """added, changed or unchanged for every fetch, by the last hash kept for its url.

    A hash older than ``days`` at the next fetch has expired: the page counts as added again.  When the
    watermark, ``late`` behind the latest fetch, passes that age, the hash is removed from the state.
    """
    kept_for = pd.Timedelta(days=days)

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, when = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("fetched_at", kind="stable")
        out = []
        for h, at in zip(rows["content_hash"], rows["fetched_at"]):
            known = last is not None and pd.Timestamp(at) - pd.Timestamp(when) <= kept_for
            out.append((key[0], at, "added" if not known else "unchanged" if last == h else "changed", h))
            last, when = h, at
        expires = int((pd.Timestamp(when) + kept_for).value // 1_000_000)
        if expires > state.getCurrentWatermarkMs():
            state.update((last, pd.Timestamp(when).to_pydatetime()))
            state.setTimeoutTimestamp(expires)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["url", "fetched_at", "change", "content_hash"])

    return fetches.withWatermark("fetched_at", late).groupBy("url").applyInPandasWithState(step, _OUT, _STATE, "append", "EventTimeTimeout")
