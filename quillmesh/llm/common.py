"""Shared helpers: text buffers as numpy arrays, 64-bit hashing, sizing of exchanges."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)

#: bytes 0x09-0x0D and 0x20 separate words
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
#: units longer than this many bytes are hashed one by one
_LONG = 48


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), on a copy."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``data``; equal contents give equal hashes."""
    import xxhash

    n = len(starts)
    if n == 0:
        return np.zeros(0, U64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    length = ends - starts
    h = mix64(length.astype(U64) + _GOLD)
    live = np.flatnonzero(length <= _LONG)
    at, left = starts[live], length[live]
    while len(live):
        some = left > 0
        if not some.all():
            live, at, left = live[some], at[some], left[some]
            if not len(live):
                break
        block = words[at] & _TAIL[np.minimum(left, 8)]
        h[live] = mix64((h[live] ^ block) * _GOLD + block)
        at = at + 8
        left = left - 8
    for i in np.flatnonzero(length > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return h


def window_hashes(units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hashes (64 and 32 bits) of every k consecutive units, by doubling."""
    out = []
    for seed, base in ((U64(0x2545F4914F6CDD1D), 0xD6E8FEB86659FD93), (U64(0x369DEA0F31A53F85), 0xC2B2AE3D27D4EB4F)):
        cur, size, acc, done = mix64(units + seed), 1, None, 0
        power = pow(base, 1, 1 << 64)
        bits = k
        while bits:
            if bits & 1:
                if acc is None:
                    acc, done = cur, size
                else:
                    m = len(units) - done - size + 1
                    acc = acc[:m] * U64(power) + cur[done : done + m]
                    done += size
            bits >>= 1
            if bits:
                m = len(cur) - size
                cur = cur[:m] * U64(power) + cur[size : size + m]
                size *= 2
                power = power * power % (1 << 64)
        out.append(mix64(acc))
    return out[0], (out[1] >> U64(32)).astype(np.uint32)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and row offsets of a string column (nulls count as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, body = column.buffers()
    offsets = np.frombuffer(off, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer row is a range of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        out.append((i, j))
        i = j
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never run over a row's end."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows.astype(np.int32)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; n line feeds make n + 1 lines."""
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], feeds + 1])
    ends = np.concatenate([offsets[1:], feeds])
    rows_of = np.searchsorted(offsets, feeds, side="right") - 1
    rows = np.concatenate([np.arange(len(offsets) - 1), rows_of])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = ends[np.lexsort((ends, np.concatenate([np.arange(len(offsets) - 1), rows_of])))]
    return starts, ends, rows.astype(np.int32)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of the texts; one aggregated row reaches the driver."""
    return docs.agg(F.sum(F.octet_length(column).cast("long")).alias("b")).first()["b"] or 0


def shards_for(total: int, each: int, least: int = 4) -> int:
    """How many parts of about ``each`` bytes hold ``total``."""
    return max(least, -(-int(total) // each))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; set only where unset."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillmesh-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def lean(run):
    """A function over Arrow batches that has Arrow's pool give back at the end what it has freed: workers wait for their next task with it otherwise."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def settled(df: DataFrame) -> DataFrame:
    """Computed once into the shared checkpoint folder; lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Computed once into a Parquet table in the shared checkpoint folder, of which single columns can be read."""
    folder = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def joined_in_parts(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, many: int = 100_000, most: int = 200_000) -> DataFrame:
    """``rows`` joined with ``table``, which holds each key once; keys of over ``many`` rows are dealt over several tasks.

    ``counts`` (key, c) tells how many rows have each key.  At most rows / ``many`` keys are crowded; they are
    broadcast up to ``most`` of them.  ``rows`` must be settled.
    """
    crowded = counts.filter(F.col("c") > many).select(key, F.ceil(F.col("c") / many).cast("int").alias("_parts"))
    n = crowded.count()
    if not n:
        return rows.join(table, key)
    crowded = F.broadcast(crowded) if n <= most else crowded
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(crowded, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_parts")
    copies = table.join(crowded, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def refuse_clash(given: list[str], added: list[str]) -> None:
    """A table that already has a column which an operator adds is refused, with the names."""
    both = [c for c in added if c in given]
    if both:
        raise ValueError(f"the table already has columns that are added here: {', '.join(both)}; rename them first")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(column) -> np.ndarray:
    """Integer ids as int64; null sorts before all others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(-(1 << 63))
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)
