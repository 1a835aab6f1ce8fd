"""Near duplicates by the Jaccard similarity of word-shingle sets: candidates, then whole sets.

Pairs to look at come from two indexes.  SimHash fingerprints that the Gray-order index links give the
closest copies.  Minima of the shingles under many orders, taken in bands, give the rest: two sets of
similarity 4/5 agree in all minima of some band with probability 0.9996.  What a bucket of either
index holds is tied to one member of the bucket and not paired among itself, so there are fewer pairs
than entries; in small buckets all that is still apart is paired.  Larger buckets that still hold sets
apart, as those of one template do, make clusters by the sets that they share, and all sets of a cluster
are held against each other, block by block.  Only sets of very large clusters get longer and more bands
of minima first, level by level, which break such clusters up; what is left of these at the last level is
held against each other in the same way, whatever its size.  Every pair is held against the whole sets,
so what is linked is always similar enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, hash_spans, joined_in_parts, lean, mix64, refuse_clash, settled, slices, text_buffer, word_spans
from quillmesh.llm.components import components
from quillmesh.llm.gray_index import Unions
from quillmesh.llm.simhash import fingerprints_of, near_links

SHINGLE = 5
#: the similarity as a fraction
UP, DOWN = 4, 5
BANDS, MINIMA = 20, 5
CHUNK_BYTES = 1 << 20
#: parts of a bucket, each with a member of its own, so that no bucket is one task's
PARTS = 16
#: (bands, minima) for the sets of larger buckets that are still apart: two sets of similarity 4/5 share a band
#: of the first level with probability 0.99999, of the second with 0.9996; sets of similarity 2/3 with a chance
#: of 0.039 and 0.0077 a band
DEEPER = ((64, 8), (110, 12))
#: sets of a bucket up to which those still apart are paired one by one; members that they are held against
#: first in a larger one
SMALL, LOOKS = 32, 2
#: sets of a cluster of larger buckets up to which it isn't broken up before all are held against each other;
#: sets and bytes of a block of a cluster
WHOLE, BLOCK, BLOCK_BYTES = 16_000, 500, 4 << 20
#: sets of a block that share a shingle, up to which they are counted pair by pair; shingles counted at once above it
FEW, COLUMNS = 8, 2048
#: pairs of one set that meet in one task
TOGETHER = 2000
#: sets of which one part of a table holds what belongs to them
SETS = 5_000
#: rows up to which a list of sets is broadcast
BROADCAST_ROWS = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ORDERS = mix64(np.arange(1, BANDS * MINIMA + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, sorted within each, and where each row's begin.

    Words are those of SimHash, with ASCII letters in lower case; fewer words than a shingle make one.
    """
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    unit = hash_spans(_LOWER[data], starts, ends)
    words = np.bincount(rows, minlength=n)
    hashes, owner = [], []
    acc = np.zeros(len(unit), U64)
    for k in range(min(shingle, len(unit))):
        acc = mix64(acc[: len(unit) - k] + unit[k:] + U64(k + 1))
        left, right = rows[: len(acc)], rows[k:]
        own = (left == right) if k == shingle - 1 else (left == right) & (words[left] == k + 1)
        hashes.append(acc[own])
        owner.append(left[own])
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    row = np.concatenate(owner) if owner else np.zeros(0, np.int32)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def set_names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set; an empty set's is that of zero shingles."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h + U64(0x9E3779B97F4A7C15)), dtype=U64)])
    return mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64))


def band_keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have shingles, and a key for each of their bands: the minima of its orders, folded."""
    some = np.flatnonzero(np.diff(bounds))
    keys = np.empty((len(some), BANDS), U64)
    at = bounds[some]
    for band in range(BANDS):
        key = np.full(len(some), band + 1, U64)
        for order in _ORDERS[band * MINIMA : (band + 1) * MINIMA] if len(some) else ():
            key = mix64(key ^ np.minimum.reduceat(h * order, at))
        keys[:, band] = key
    return some, keys


def deep_keys(sets: DataFrame, bands: int, minima: int) -> DataFrame:
    """(node, n, keys) of sets (node, body): a key for each band of that many minima."""
    orders = mix64(np.arange(1, bands * minima + 1, dtype=U64) * U64(0xD1B54A32D192ED03) + U64(minima))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [np.frombuffer(x.as_buffer(), np.uint32).astype(U64) for x in part.column(1)]
                h, at = np.concatenate(rows), np.cumsum([0, *map(len, rows)])[:-1]
                keys = np.empty((len(rows), bands), U64)
                for band in range(bands):
                    key = np.full(len(rows), U64(band + 1) + (U64(minima) << U64(32)), U64)
                    for order in orders[band * minima : (band + 1) * minima]:
                        key = mix64(key ^ np.minimum.reduceat(mix64(h ^ order), at))
                    keys[:, band] = key
                listed = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * bands).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in rows], pa.int64()), listed], names=["node", "n", "keys"])

    return sets.filter(F.octet_length("body") > 0).select("node", "body").mapInArrow(lean(run), "node long, n long, keys array<long>")


def _marks(docs: DataFrame, shingle: int) -> DataFrame:
    """(_id, node, n, keys, fp): each row's set by name, its size, its band keys and its fingerprint."""

    def run(batches):
        for whole in batches:
            _, sizes = text_buffer(whole.column(1))
            for i, j in slices(sizes, CHUNK_BYTES):
                batch = whole.slice(i, j - i)
                data, offsets = text_buffer(batch.column(1))
                h, bounds = shingle_sets(data, offsets, shingle)
                some, keys = band_keys(h, bounds)
                held = np.zeros(j - i + 1, np.int32)
                held[some + 1] = BANDS
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum(held).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                fp = fingerprints_of(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(set_names(h, bounds).view(np.int64)), pa.array(np.diff(bounds)), listed, pa.array(fp.view(np.int64))], names=["_id", "node", "n", "keys", "fp"])

    return docs.mapInArrow(lean(run), f"_id {docs.schema['_id'].dataType.simpleString()}, node long, n long, keys array<long>, fp long")


def _bodies(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, body): each row's set, 32 bits a shingle."""

    def run(batches):
        for whole in batches:
            _, sizes = text_buffer(whole.column(0))
            for i, j in slices(sizes, CHUNK_BYTES):
                h, bounds = shingle_sets(*text_buffer(whole.column(0).slice(i, j - i)), shingle)
                short = (h >> U64(32)).astype(np.uint32)  # the upper half, so still in order
                body = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([pa.array(set_names(h, bounds).view(np.int64)), body], names=["node", "body"])

    return docs.select("_text").mapInArrow(lean(run), "node long, body binary")


def _fit(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, an, b, bn) of different sets whose sizes leave the similarity possible, once each."""
    least, most = F.least("an", "bn"), F.greatest("an", "bn")
    return pairs.filter((F.col("a") != F.col("b")) & (DOWN * least >= UP * most)).select("a", "b").distinct()


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, part, c, node, n) of the buckets that more than one set is in; c is how many."""
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part")
    own = ["root"] if "root" in nodes.columns else []
    entries = nodes.select("node", "n", *own, part, F.explode("keys").alias("key"))
    counts = entries.groupBy("key", "part").agg(F.count("*").alias("c"))
    many = counts.groupBy("key").agg(F.sum("c").alias("c"), F.collect_list("part").alias("parts")).filter("c > 1").select("key", "c", F.explode("parts").alias("part"))
    return entries.join(many, ["key", "part"]).select("key", "part", "c", "node", "n", *own)


def stars(shared: DataFrame, seed: int, by_key: bool) -> DataFrame:
    """(a, b): every set of a bucket's part with one of them, and these with one of the bucket.

    ``seed`` decides which: the same ones in all buckets, so that most pairs come again, or ``by_key``
    others in each.  Sets that ``shared`` says to be joined already (root) are left out.
    """
    rank = F.xxhash64(F.lit(seed), "node", "key") if by_key else F.xxhash64(F.lit(seed), "node")
    one = F.min(F.struct(rank.alias("rank"), "node", "n", "root"))
    low = shared.groupBy("key", "part").agg(one.alias("r"))
    top = low.groupBy("key").agg(F.min("r").alias("t"))
    inside = shared.join(low, ["key", "part"]).filter(F.col("root") != F.col("r.root")).select(F.col("r.node").alias("a"), F.col("r.n").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn"))
    across = low.join(top, "key").filter(F.col("r.root") != F.col("t.root")).select(F.col("t.node").alias("a"), F.col("t.n").alias("an"), F.col("r.node").alias("b"), F.col("r.n").alias("bn"))
    return _fit(inside.unionByName(across))


def small_buckets(shared: DataFrame) -> DataFrame:
    """(a, b): what is apart in buckets of at most SMALL sets, so at most that many pairs a set and bucket."""
    lists = shared.filter(F.col("c") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("node", "n", "root")).alias("x"))
    after = lambda x, i: F.filter(F.slice("x", i + 2, SMALL), lambda y: y["root"] != x["root"])
    pairs = F.flatten(F.transform("x", lambda x, i: F.transform(after(x, i), lambda y: F.struct(x["node"].alias("a"), x["n"].alias("an"), y["node"].alias("b"), y["n"].alias("bn")))))
    rows = _fit(lists.select(F.explode(pairs).alias("p")).select("p.*"))
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): the sets of like fingerprints, by the Gray-order index."""
    first = settled(nodes.filter("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("m")))
    same = nodes.filter("n > 0").join(first, "fp").select(F.col("m.node").alias("a"), F.col("m.n").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn"))
    links = near_links(first.select("fp"))
    of = lambda side: first.select(F.col("fp").alias(side), F.col("m").alias(f"m_{side}"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(F.col("m_a.node").alias("a"), F.col("m_a.n").alias("an"), F.col("m_b.node").alias("b"), F.col("m_b.n").alias("bn"))
    return _fit(same.unionByName(near))


def _small(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def bodies_of(needed: DataFrame, docs: DataFrame, shingle: int, parts: int) -> DataFrame:
    """(node, body) of the sets that are needed (node), once each."""
    return settled(_bodies(docs, shingle).join(_small(needed), "node", "left_semi").dropDuplicates(["node"]).coalesce(parts))


def still_apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shared`` with each set's root, of the buckets that hold more than one."""
    rooted = shared
    if "root" not in shared.columns:
        rooted = shared.join(roots, "node", "left").select("key", "part", "c", "node", "n", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b").select("key")
    parts = several.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rooted.join(parts, ["key", "part"], "left_semi")


def clusters(crowded: DataFrame) -> DataFrame:
    """(node, n, cluster, blocks): the sets of larger buckets; those that are joined by shared buckets are one cluster."""
    first = crowded.groupBy("key").agg(F.min("node").alias("first"))
    parts = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named = components(crowded.join(parts, ["key", "part"]).select("node", "first").distinct())
    own = crowded.select("node", "n").distinct().join(named.select("node", F.col("root").alias("cluster")), "node")
    sizes = own.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(4 * F.col("total") / BLOCK_BYTES)).cast("int").alias("blocks")
    return own.join(sizes.select("cluster", "c", blocks), "cluster").select("node", "n", "cluster", "c", "blocks")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of the left shares with each of the right."""
    n, m = len(left), len(right)
    values = np.concatenate([*left, *right])
    row = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    order = np.lexsort((row, values))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    once = new.copy()
    once[1:] |= row[1:] != row[:-1]
    row, starts = row[once], np.flatnonzero(new[once])
    sizes = np.diff(np.append(starts, len(row)))
    out = np.zeros(n * m, np.int64)
    for size in range(2, FEW + 1):
        at = starts[sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                a, b = row[at + i], row[at + j]  # in order, so a set of the left comes first
                good = (a < n) & (b >= n)
                out += np.bincount(a[good] * m + (b[good] - n), minlength=n * m)
    out = out.reshape(n, m)
    wide = np.flatnonzero(sizes > FEW)
    for k in range(0, len(wide), COLUMNS):
        some = wide[k : k + COLUMNS]
        held_by = np.zeros((n + m, len(some)), np.float32)
        size = sizes[some]
        column = np.repeat(np.arange(len(some)), size)
        held_by[row[np.repeat(starts[some] - np.cumsum(size) + size, size) + np.arange(size.sum())], column] = 1
        out += (held_by[:n] @ held_by[n:].T).astype(np.int64)
    return out


def block_links(sets: DataFrame) -> DataFrame:
    """(a, b) that connect what is similar in each cluster, of (node, cluster, blocks, body).

    Sets are dealt to a cluster's blocks, and each two blocks meet in a group of their own.  Of a group's
    similar sets each is tied to the first that it reaches, so there are no more rows than sets.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    copies = sets.withColumn("own", own).select("node", "cluster", "own", "body", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = copies.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "body")

    def run(table: pa.Table) -> pa.Table:
        nodes, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        bodies = [np.frombuffer(x.as_buffer(), np.uint32) for chunk in table.column("body").chunks for x in chunk]
        low = np.flatnonzero(own == table.column("low")[0].as_py())
        high = np.flatnonzero(own == table.column("high")[0].as_py())
        size = np.array([len(b) for b in bodies])
        same = shared_counts([bodies[i] for i in low], [bodies[i] for i in high])
        a, b = np.nonzero((DOWN + UP) * same >= UP * (size[low][:, None] + size[high][None, :]))
        unions = Unions(len(nodes))
        unions.join(low[a], high[b])
        tied = np.flatnonzero(unions.label != np.arange(len(nodes)))
        return pa.table({"a": nodes[unions.label[tied]], "b": nodes[tied]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return pairs.groupBy("cluster", "low", "high").applyInArrow(run, "a long, b long")


def held(pairs: DataFrame, docs: DataFrame, shingle: int, parts: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity; a set in many pairs meets them in many tasks."""
    needed = settled(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().coalesce(parts))
    sets = bodies_of(needed, docs, shingle, parts)
    busy = settled(pairs.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > TOGETHER).select("a", F.ceil(F.col("c") / TOGETHER).cast("int").alias("tasks")).coalesce(parts))
    busy = _small(busy)
    tasks = F.coalesce("tasks", F.lit(1))
    dealt = pairs.join(busy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), tasks).cast("int").alias("task"))
    own = sets.select(F.col("node").alias("a"), F.col("body").alias("_x")).join(busy, "a", "left").select("a", "_x", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"))
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("body").alias("_y")), "b").join(own, ["a", "task"]).select("a", "b", "_x", "_y")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                every = np.concatenate([x, y])
                every.sort()
                # shingles of one set whose 32 bits agree count as they do in the other set
                same = int(np.count_nonzero(every[1:] == every[:-1]))
                good.append(DOWN * same >= UP * (len(every) - same))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(lean(run), "a long, b long")


def similar_groups(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, component_id): documents connected by pairs of similarity 4/5 or more share the smallest id.

    ``node`` names the document's set.  Texts without words (null, empty or blank) have equal, empty
    sets and are one group; fewer words than a shingle make one shingle.  Null ids are never a
    component's id unless all its ids are null.  Repeated rows come back as they are; other columns
    are not carried; an id column called node or component_id is refused with a ValueError; an empty
    table gives an empty result.
    """
    refuse_clash([id_col], ["node", "component_id"])
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    marks = settled(_marks(slim, shingle))
    nodes = settled(marks.groupBy("node").agg(F.min("_id").alias("_first"), F.max("n").alias("n"), F.min("keys").alias("keys"), F.min("fp").alias("fp"), F.count("*").alias("c")))
    # what follows is about sets: parts of it hold some thousands each, so a small table isn't scattered over many files
    parts = max(1, -(-nodes.count() // SETS))
    shared = settled(shared_buckets(nodes.filter("n > 0")).coalesce(parts))
    pairs = settled(stars(shared.withColumn("root", F.col("node")), 0, False).unionByName(fingerprint_pairs(nodes)).distinct().coalesce(parts))
    links = settled(held(pairs, slim, shingle, parts).coalesce(parts))
    roots = settled(components(links).coalesce(parts))
    for depth in range(len(DEEPER) + 1):
        # what is still apart meets others of each bucket that it shares, in small ones all
        apart = settled(still_apart(shared, roots).coalesce(parts))
        more = small_buckets(apart)
        for seed in range(1, LOOKS + 1):
            more = more.unionByName(stars(apart.filter(F.col("c") > SMALL), seed, True))
        more = settled(more.join(pairs, ["a", "b"], "left_anti").distinct().coalesce(parts))
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            links = settled(links.unionByName(held(more, slim, shingle, parts)).coalesce(parts))
            roots = settled(components(links).coalesce(parts))
        crowded = settled(still_apart(apart.filter(F.col("c") > SMALL).drop("root"), roots).coalesce(parts))
        if crowded.isEmpty():
            break
        grouped = settled(clusters(crowded).coalesce(parts))
        now = grouped if depth == len(DEEPER) else grouped.filter(F.col("c") <= WHOLE)
        if not now.isEmpty():
            links = settled(links.unionByName(block_links(now.join(bodies_of(now.select("node"), slim, shingle, parts), "node"))).coalesce(parts))
            roots = settled(components(links).coalesce(parts))
        large = settled(grouped.filter(F.col("c") > WHOLE).select("node").coalesce(parts))
        if depth == len(DEEPER) or large.isEmpty():
            break
        # each set brings its root along, so that its many keys need not look for it
        rooted = deep_keys(bodies_of(large, slim, shingle, parts), *DEEPER[depth]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        shared = settled(shared_buckets(rooted).coalesce(parts))
    inside = roots.join(nodes, "node").select("node", "root", "_first")
    lowest = inside.groupBy("root").agg(F.min("_first").alias("_least"))
    named = nodes.join(inside.select("node", "root").join(lowest, "root").select("node", "_least"), "node", "left").select("node", F.coalesce("_least", "_first").alias("component_id"))
    rows = marks.select(F.col("_id").alias(id_col), "node")
    return joined_in_parts(rows, named, "node", nodes).select(id_col, "node", "component_id")
