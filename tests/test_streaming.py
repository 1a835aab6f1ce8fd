"""Changes over streams of page files, against batch comparison, with snapshots that expire."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import diff as D
from quillmesh.streaming.changes import PAGES, change_stream, fetch_hashes, read_stream
from quillmesh.streaming.snapshots import block_changes, fetched_blocks, with_state_store

FETCHES = PAGES + ", fetched_at timestamp"


@pytest.fixture
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield with_state_store(spark)
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_changes_arrive_once_each(spark, tmp_path):
    folder = tmp_path / "in"
    for k, text in enumerate(("one", "one", "two")):
        spark.createDataFrame([(1, "u", f"<p>{text}")], PAGES).coalesce(1).write.mode("append").parquet(str(folder))
        if k == 0:
            spark.createDataFrame([(2, "v", "<p>x")], PAGES).coalesce(1).write.mode("append").parquet(str(folder))
    stream = change_stream(fetch_hashes(read_stream(spark, str(folder))))
    q = stream.writeStream.format("memory").queryName("page_changes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    rows = spark.table("page_changes").collect()
    found = {u: sorted(r.change for r in rows if r.url == u) for u in ("u", "v")}
    assert found == {"u": ["added", "changed", "unchanged"], "v": ["added"]}


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


class Feed:
    """A folder of fetches that a stream reads, one call at a time."""

    def __init__(self, spark, tmp_path, name, days=30):
        self.spark, self.folder, self.state, self.name, self.days = spark, str(tmp_path / "fetches"), str(tmp_path / "state"), name, days
        self.rows = []

    def send(self, *fetches):
        self.spark.createDataFrame([(k, u, h, at) for k, (u, at, h) in enumerate(fetches)], FETCHES).coalesce(1).write.mode("append").parquet(self.folder)
        stream = block_changes(fetched_blocks(self.spark.readStream.schema(FETCHES).parquet(self.folder)), days=self.days)
        got = []
        q = stream.writeStream.foreachBatch(lambda frame, _: got.extend(frame.collect())).option("checkpointLocation", self.state).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        self.kept = sum(s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"])
        return sorted((r.url, r.fetched_at, r.change_ord, r.change, r.before, r.after) for r in got)


def test_block_changes_are_those_of_batch_and_expire(state_store, tmp_path):
    spark = state_store
    feed = Feed(spark, tmp_path, "blocks")
    one = "<p>same</p><p>old</p><ul><li><a href='/1'>x</a></li></ul><p>same</p>"
    two = "<p>new</p><ul><li><a href='/2'>x</a></li></ul><p>same</p>"
    assert [r[3] for r in feed.send(("u", day(0), one), ("v", day(0), "<p>v</p>"))] == ["added"] * 4
    got = feed.send(("u", day(1), two))

    def side(html):
        return fetched_blocks(spark.createDataFrame([(1, "u", html, day(0))], FETCHES))

    want = D.changes(side(one), side(two)).select("change_ord", "change", "before", "after").collect()
    assert [r[2:] for r in got] == sorted(tuple(r) for r in want)
    assert {r[3] for r in got} == {"added", "changed", "unchanged", "removed"}
    # a page without blocks has all of them removed, an older fetch changes nothing, two fetches of a batch follow one another
    assert [r[3] for r in feed.send(("u", day(2), "")) ] == ["removed"] * 3
    assert feed.send(("u", day(1, 5), one)) == []
    assert [(r[1], r[3]) for r in feed.send(("u", day(4), "<p>b</p>"), ("u", day(3), "<p>a</p>"))] == [(day(3), "added"), (day(4), "added"), (day(4), "removed")]
    # after its time a snapshot counts no more, though no timer has run yet
    assert [r[3] for r in feed.send(("u", day(40), "<p>b</p>"))] == ["added"]


def test_state_shrinks_when_snapshots_expire(state_store, tmp_path):
    feed = Feed(state_store, tmp_path, "expiry", days=5)
    feed.send(*[(f"u{k}", day(0), f"<p>{k}</p><p>two</p>") for k in range(30)])
    full = feed.kept
    feed.send(("w", day(20), "<p>w</p>"))  # moves the watermark past all of them
    feed.send(("w", day(21), "<p>w</p>"))
    assert full >= 30 and feed.kept < full / 5
    # and a forgotten page comes back as new
    assert [r[3] for r in feed.send(("u3", day(21, 1), "<p>3</p><p>two</p>"))] == ["added", "added"]


def test_a_snapshot_is_one_value_of_the_state():
    """Not an entry for each block: the state store is asked once a fetch, whatever the page holds."""
    from unittest.mock import MagicMock

    from quillmesh.streaming.snapshots import BlockChanges

    handle = MagicMock()
    BlockChanges(30).init(handle)
    assert handle.getValueState.call_count == 1 and not handle.getMapState.called
