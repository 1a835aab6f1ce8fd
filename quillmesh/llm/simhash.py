"""Operator 4, SimHash near-dedup: fingerprints of word shingles, linked through a Gray-order index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, documents, joined_in_parts, lean, refuse_clash, settled, slices, text_buffer, word_spans
from quillmesh.llm.components import components
from quillmesh.llm.gray_index import HALF, STEP, Router, lead_within, linked, turned

SHINGLE = 4
WITHIN = 4
SEED = 42
CHUNK_BYTES = 1 << 20
#: fingerprints that one shard should not exceed
SHARD = 16_000
#: leading bits that the upper nodes look at
UPPER = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each row's words."""
    from xxhash import xxh64_intdigest

    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    out = np.zeros(n, U64)
    if not len(starts):
        return out
    length = ends - starts
    # words of lower-case letters, each followed by one space
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
    joined[np.arange(len(inside)) + np.repeat(np.arange(len(length)), length)] = _LOWER[data[inside]]
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    stop = begin + length
    words = np.bincount(rows, minlength=n)
    last = np.minimum(np.arange(len(rows)) + shingle - 1, np.cumsum(words)[rows] - 1)
    first_word = (np.cumsum(words) - words)[rows]
    whole = (np.arange(len(rows)) + shingle - 1 <= last) | ((words[rows] < shingle) & (np.arange(len(rows)) == first_word))
    at = np.flatnonzero(whole)
    body = joined.tobytes()
    hashes = np.array([xxh64_intdigest(body[a:b], seed) for a, b in zip(begin[at].tolist(), stop[last[at]].tolist())], dtype=">u8")
    owner = rows[at]
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts = np.diff(np.append(head, len(owner)))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > counts[:, None], axis=1)
    out[owner[head]] = packed.reshape(-1).view(">u8").astype(U64)
    return out


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``fp`` (bigint, the bits of the fingerprint) to the kept columns; a kept column fp is refused with a ValueError.

    A text without words, null or empty, has fingerprint zero; repeated rows have the same; an empty
    table gives an empty result.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    refuse_clash(keep, ["fp"])
    slim = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for whole in batches:
            _, sizes = text_buffer(whole.column(len(keep)))
            for i, j in slices(sizes, CHUNK_BYTES):
                batch = whole.slice(i, j - i)
                data, offsets = text_buffer(batch.column(len(keep)))
                fp = fingerprints_of(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    ddl = ", ".join([f"c{i}_ {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["fp long"])
    return slim.mapInArrow(lean(run), ddl).select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(keep)], "fp")


def _directory(distinct: DataFrame, shard: int) -> list[dict[int, list[int]]]:
    """Per half, the prefixes (by depth) that hold at most ``shard`` fingerprints, or that are deepest.

    At most 2 ** UPPER counts for each half reach the driver, whatever the corpus.
    """
    out = []
    for half in (0, 1):
        lead = F.shiftrightunsigned(F.col("fp") if half == 0 else F.shiftleft("fp", HALF), 64 - UPPER)
        rows = distinct.groupBy(lead.alias("p")).count().collect()
        counts = np.zeros(1 << UPPER, np.int64)
        for r in rows:
            counts[r["p"]] = r["count"]
        leaves: dict[int, list[int]] = {}
        open_ = [0]
        for depth in range(0, UPPER + 1, STEP):
            sums = counts.reshape(1 << depth, -1).sum(axis=1)
            leaves[depth] = [p for p in open_ if 0 < sums[p] and (sums[p] <= shard or depth == UPPER)]
            open_ = [p * (1 << STEP) + c for p in open_ if sums[p] > shard and depth < UPPER for c in range(1 << STEP)]
        out.append(leaves)
    return out


def near_links(distinct: DataFrame, *, within: int = WITHIN, shard: int = SHARD) -> DataFrame:
    """Stars (a, b) that connect the fingerprints (``fp``, distinct) with at most ``within`` differing bits.

    Every fingerprint is a member of one shard for each half of its bits, and visits the later shards
    whose shared leading bits differ from its own in no more than that half's share of ``within``.
    """
    routers = [Router(x) for x in _directory(distinct, shard)]

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            for half in (0, 1):
                lead = turned(fp, half)
                for i in range(0, len(fp), 20_000):
                    own = lead[i : i + 20_000]
                    rows, depth, prefix = routers[half].visit(own, lead_within(half, within))
                    at_home = (own[rows] >> (64 - np.maximum(depth, 1)).astype(U64)) == prefix
                    at_home |= depth == 0
                    # the order of shards is that of their prefixes, drawn out to full length
                    start = np.where(depth == 0, U64(0), prefix << (64 - np.maximum(depth, 1)).astype(U64))
                    later = start > own[rows]
                    keep = at_home | later
                    rows, depth, prefix, at_home = rows[keep], depth[keep], prefix[keep], at_home[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), half, np.int32)), pa.array(depth.astype(np.int32)), pa.array(prefix.astype(np.int64)), pa.array(at_home), pa.array(fp[i : i + 20_000][rows].view(np.int64))],
                        names=["half", "depth", "prefix", "home", "fp"],
                    )

    def within_shard(key, table):
        fp = table.column("fp").to_numpy().view(U64)
        home = np.asarray(table.column("home").to_numpy())
        order = np.argsort(fp, kind="stable")
        fp, home = fp[order], home[order]
        both = np.concatenate([fp[home], fp[~home]])
        label = linked(fp[home], fp[~home], key[0].as_py(), key[1].as_py(), within)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": both[moved].view(np.int64), "b": both[label[moved]].view(np.int64)})

    routed = distinct.select("fp").mapInArrow(lean(route), "half int, depth int, prefix long, home boolean, fp long")
    return routed.groupBy("half", "depth", "prefix").applyInArrow(within_shard, "a long, b long")


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE, within: int = WITHIN, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints are connected by near links share the smallest id.

    Equal fingerprints count as one node, so copies are never paired.  A text without words (null,
    empty or blank) has fingerprint zero and is linked like any other; fewer words than a shingle
    make one shingle.  Null ids are never a component's id unless all its ids are null.  Repeated rows
    come back as they are; other columns are not carried; an id column called as a returned one is refused
    with a ValueError; an empty table gives an empty result.
    """
    refuse_clash([id_col], ["fp", "node", "root", "component_id", "c"])
    rows = settled(fingerprints(docs.select(id_col, text_col), shingle=shingle, text_col=text_col))
    nodes = settled(rows.groupBy("fp").agg(F.min(id_col).alias("_first"), F.count("*").alias("c")))
    roots = components(near_links(nodes.select("fp"), within=within, shard=shard))
    known = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "_first")
    lowest = known.groupBy("root").agg(F.min("_first").alias("_least"))
    inside = known.select("fp", "root").join(lowest, "root").select("fp", "_least")
    named = nodes.join(inside, "fp", "left").select("fp", F.coalesce("_least", "_first").alias("component_id"))
    return joined_in_parts(rows, named, "fp", nodes).select(id_col, "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
