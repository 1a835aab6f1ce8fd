"""As-of joins, containment, chains and the stored table of snapshots, against brute force and edge cases."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import asof
from quillmesh.operators.asof import asof_join, snapshots_as_of
from quillmesh.operators.chains import ends, paths
from quillmesh.operators.containment import contained
from quillmesh.operators.discovery import chase_redirects
from quillmesh.plans.store import SnapshotStore


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


@pytest.mark.parametrize("together", [1_000_000, 40])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_is_that_of_brute_force(spark, strict, together):
    r = random.Random(2)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(k, key(), at(r.randrange(400)) if r.random() > 0.05 else None) for k in range(400)] + [(7, "hot", at(9))] * 2
    right = [(key(), at(r.randrange(400) if r.random() > 0.3 else 77) if r.random() > 0.05 else None, r.randrange(50), f"v{r.randrange(9)}") for _ in range(500)]
    got = asof_join(
        spark.createDataFrame(left, "id long, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, n int, v string"),
        ["k"], "t", "t", {"n": "found_n", "v": "found_v", "t": "found_t"}, strict=strict, tie="n", within="60 MINUTES", together=together,
    ).collect()
    want = []
    for i, k, t in left:
        fit = [(y, n, v) for x, y, n, v in right if k is not None and x == k and t is not None and y is not None and (y < t if strict else y <= t)]
        best = max(fit, default=(None, None, None))
        best = best if best[0] is not None and t - best[0] <= dt.timedelta(minutes=60) else (None, None, None)
        want.append((i, k, t, best[1], best[2], best[0]))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got) == order(want)


def test_asof_cuts_long_histories(spark):
    rows = spark.range(10_000).select(F.lit("u").alias("k"), F.timestamp_seconds("id").alias("_t"))
    cuts = asof._ranges(rows, ["k"], 1000).first()["_cuts"]
    assert 8 <= len(cuts) <= 10 and cuts == sorted(cuts)
    assert asof._ranges(rows, ["k"], 10_000) is None


def test_snapshots_as_of_and_clashes(spark):
    history = spark.createDataFrame([("u", at(0), "h0"), ("u", at(100), "h1"), ("v", at(0), "x")], "url string, fetched_at timestamp, content_hash string")
    asked = spark.createDataFrame([("u", at(50)), ("u", at(100)), ("v", at(60 * 24 * 3)), ("w", at(1))], "url string, at timestamp")
    got = {(r["url"], r["at"]): r["content_hash"] for r in snapshots_as_of(asked, history, days=2).collect()}
    assert got == {("u", at(50)): "h0", ("u", at(100)): "h1", ("v", at(60 * 24 * 3)): None, ("w", at(1)): None}
    assert snapshots_as_of(asked, history.limit(0), days=2).filter("content_hash IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="url"):
        asof_join(asked, history, ["url"], "at", "fetched_at", {"fetched_at": "url"})


@pytest.mark.parametrize("few", [200_000, 0])
def test_containment_is_that_of_brute_force(spark, few):
    r = random.Random(4)
    words = ["the", "cat", "sat", "on", "mat", "été", "a", "x1", "東京", "🙂"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 14))) + r.choice(["", "\n", "  end", ""]) for _ in range(120)] + [None, "", "the cat sat", "the cat sat"]
    needles = ["", None, "a", "🙂", "at", "sat on", "he cat s", "cat sat on", "e cat sat o", "the  cat", " mat", "mat ", "nowhere at all here", "the cat sat", "té a", "東", "\n", "x1 x1 x1 x1 x1"]
    needles += [t[r.randrange(len(t)) :][: r.randrange(1, 20)] for t in texts if t]
    a = spark.createDataFrame(list(enumerate(needles)) + [(0, "dup"), (2, "a")], "n long, s string")
    b = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "t long, x string")
    got = sorted(map(tuple, contained(a, b, needle_id="n", needle="s", text_id="t", text="x", broadcast_rows=few).collect()))
    want = sorted((i, j) for i, s in enumerate(needles) if s for j, x in [*enumerate(texts), (5, texts[5])] if x is not None and s in x)
    assert got == want


def test_containment_has_no_nested_loop(spark, data):
    frames = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("benchmark", "documents")]
    plan = contained(*frames, needle_id="item_id", needle="text", text_id="doc_id", text="text")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("hub_rows", [100_000, 3])
def test_chains_end_where_walking_ends(spark, hub_rows):
    r = random.Random(6)
    moves = {k: k + 1 for k in range(300)}  # a long chain
    moves |= {k: 1000 for k in range(400, 440)} | {1000: 1001}  # a hub
    moves |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000, 3000: 3000, 4000: None}  # circles, and a move to nowhere
    moves |= {k: r.randrange(5000, 5200) for k in range(5000, 5100)}

    def walk(u):
        seen, n = {u}, 0
        while moves.get(u) is not None:
            u, n = moves[u], n + 1
            if u in seen:
                return None, None
            seen.add(u)
        return u, n

    frame = spark.createDataFrame(list(moves.items()), "u long, to long")
    assert {r["u"]: (r["end"], r["hops"]) for r in ends(frame, hub_rows=hub_rows).collect()} == {u: walk(u) for u in moves}
    assert ends(frame.limit(0)).count() == 0

    def path(u, most):
        out = []
        while len(out) < most and moves.get(u) is not None:
            u = moves[u]
            out.append(u)
        return out

    some = spark.createDataFrame([x for x in moves.items() if x[1] is not None], "u long, to long")
    for most in (1, 7, 10):
        assert {r["u"]: r["path"] for r in paths(some, most).collect()} == {u: path(u, most) for u in moves if moves[u] is not None}


def test_redirects_land_fail_and_go_on_for_too_long(spark):
    rows = [(f"https://{h}.org/{k}", 302 if k < n else 200, str(k + 1) if k < n else None) for h, n in (("x", 9), ("y", 10)) for k in range(n + 1)] + [("https://c.org/a", 301, "/a")]
    table = spark.createDataFrame(rows, "url string, status int, location string")
    asked = spark.createDataFrame([("https://x.org/0",), ("https://y.org/0",), ("https://z.org/",), ("https://c.org/a",), ("https://x.org/9",), ("https://x.org/0",)], "url string")
    got = sorted((r["url"], r["final_url"], r["status"], len(r["redirects"]), r["error"]) for r in chase_redirects(asked, table).collect())
    x = ("https://x.org/0", "https://x.org/9", 200, 9, None)
    assert got == [("https://c.org/a", "https://c.org/a", 502, 10, "too many redirects"), x, x, ("https://x.org/9", "https://x.org/9", 200, 0, None), ("https://y.org/0", "https://y.org/10", 502, 10, "too many redirects"), ("https://z.org/", "https://z.org/", 502, 0, "fetch failed")]


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_store_rewrites_only_what_it_touches(spark, tmp_path):
    ddl = "url string, fetched_at timestamp, content_hash string"
    path = str(tmp_path / "store")
    store = SnapshotStore(spark, path, buckets=32)
    first = spark.createDataFrame([(f"u{k}", at(k % 50), "old") for k in range(600)], ddl)
    assert store.upsert(first) == 32 and store.table().count() == 600
    before = files_of(path)
    second = spark.createDataFrame([(f"u{k}", at(1000), "new") for k in range(6)] + [("u7", at(-1), "older"), ("u8", at(8), "same time"), ("new", at(3), "n")], ddl)
    touched = {r[0] for r in second.select(store._bucket()).distinct().collect()}
    assert store.upsert(second) == len(touched) < 12
    after = files_of(path)
    bucket = lambda f: int(os.path.basename(os.path.dirname(f)).split("=")[1])
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if bucket(f) not in touched}
    want = {f"u{k}": "old" for k in range(600)} | {f"u{k}": "new" for k in range(6)} | {"u8": "same time", "new": "n"}
    assert {r["url"]: r["content_hash"] for r in store.table().collect()} == want
    assert {r["url"] for r in store.read(spark.createDataFrame([("u3",), ("new",), ("nope",)], "url string")).collect()} == {"u3", "new"}
    assert store.upsert(first.limit(0)) == 0
    with pytest.raises(ValueError, match="url"):
        store.upsert(spark.createDataFrame([(None, at(0), "x")], ddl))
    # fetched up to a day before, the rest goes, and a bucket without rows with it
    assert store.expire(F.lit(at(999)) + F.expr("INTERVAL 1 DAY"), days=1) == 32
    assert {r["url"] for r in store.table().collect()} == {f"u{k}" for k in range(6)}
    assert store.expire(F.lit(at(999)), days=1) == 0
