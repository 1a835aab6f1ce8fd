"""Block-level changes over a stream of fetches, against snapshots that are kept as state and expire."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillmesh.operators.diff import SNAPSHOT_DAYS, keyed
from quillmesh.operators.sections import flat_blocks
from quillmesh.sources.pages import parse_pages, with_fetch_columns

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "url string, fetched_at timestamp, change_ord int, change string, key string, classification string, before string, after string"
_SNAPSHOT = "fetched_at timestamp, blocks array<struct<key:string,ord:bigint,content:string,classification:string>>"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that keeps maps, values and timers of a processor."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def fetched_blocks(pages: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """(url, fetched_at, ord, key, content, classification) of each page's snapshot blocks; one blank row for a page without any.

    A page that can't be parsed is no fetch: it leaves its url's snapshot as it is.
    """
    parsed = parse_pages(with_fetch_columns(pages), want=("blocks",), keep=(fetched_at,)).filter("error IS NULL")
    rows = parsed.select("url", fetched_at, F.explode_outer(flat_blocks(F.col("blocks"))).alias("_b")).select("url", fetched_at, "_b.*")
    return keyed(rows).select("url", fetched_at, F.col("ord").cast("long").alias("ord"), F.when(F.col("ord").isNotNull(), F.col("key")).alias("key"), "content", "classification")


def _absent(x) -> bool:
    return x is None or x is pd.NaT or (isinstance(x, float) and x != x)


class BlockChanges(StatefulProcessor):
    """Of one url: its last snapshot, as one value with the time it was taken, and a timer to forget it.

    A map of blocks would ask the state store once for each block; all of them are read at every fetch anyway.
    """

    def __init__(self, days: int):
        self.kept_for = pd.Timedelta(days=days)

    def init(self, handle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", _SNAPSHOT)

    def _last(self):
        """(when, {key: (ord, content, classification)}) of the snapshot; (None, {}) without one."""
        kept = self.snapshot.get()
        if kept is None:
            return None, {}
        return pd.Timestamp(kept[0]), {b[0]: tuple(b[1:]) for b in kept[1]}

    def handleInputRows(self, key, rows, timerValues):
        every = pd.concat(list(rows))
        when, last = self._last()
        known, out = {**last}, []
        for at, fetch in every.groupby("fetched_at", sort=True):
            if when is not None and at <= when:
                continue  # an older fetch changes nothing: the snapshot is later
            if when is not None and at - when > self.kept_for:
                known = {}
            now: dict = {}
            for ord_, k, content, label in sorted(zip(fetch["ord"], fetch["key"], fetch["content"], fetch["classification"]), key=lambda x: (_absent(x[0]), x[0])):
                if not _absent(k):
                    # of a repeated key the last content at the first place
                    now[k] = (now[k][0] if k in now else int(ord_), None if _absent(content) else content, None if _absent(label) else label)
            listed = [(k, *now[k]) for k in sorted(now, key=lambda k: now[k][0])]
            listed += [(k, *known[k]) for k in sorted((k for k in known if k not in now), key=lambda k: known[k][0])]
            for n, (k, _, content, label) in enumerate(listed):
                before, after = known.get(k), now.get(k)
                change = "added" if before is None else "removed" if after is None else "unchanged" if before[1] == after[1] else "changed"
                label = label if label is not None else before and before[2]
                out.append((key[0], at, n, change, k, label, before and before[1], after and after[1]))
            known, when = now, at
        if out:
            self.snapshot.update((when.to_pydatetime(), [(k, *v) for k, v in known.items()]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((when + self.kept_for).value // 1_000_000))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"change_ord": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.snapshot.clear()
        return iter(())

    def close(self) -> None:
        pass


def block_changes(blocks: DataFrame, *, days: int = SNAPSHOT_DAYS, late: str = "1 hour") -> DataFrame:
    """Added, changed, unchanged and removed blocks of every fetch, against the snapshot before it.

    ``blocks`` is a stream of (url, fetched_at, ord, key, content, classification), all blocks of a fetch in
    one batch.  The rows of a fetch are those that ``operators.diff.changes`` gives for the two snapshots.  A
    snapshot is the later fetch's: one that arrives after a later fetch of its url is passed over.  A
    snapshot older than ``days`` has expired, so all blocks of the next fetch are added; when the
    watermark (``late`` behind the latest fetch) passes that age, a timer clears it, so urls
    that are not fetched any more leave nothing behind.  The session needs ``with_state_store``.
    """
    stream = blocks.withWatermark("fetched_at", late)
    return stream.groupBy("url").transformWithStateInPandas(BlockChanges(days), CHANGES, outputMode="append", timeMode="EventTime")
