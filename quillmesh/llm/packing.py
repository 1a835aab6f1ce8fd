"""Operator 2, packing: cutting stock by column generation over a histogram of lengths.

Every document is cut into full sequences and one rest.  Rests are counted by length class, at most
a few hundred numbers whatever the corpus.  On these the driver solves the cutting-stock linear
program: columns are patterns of classes that fill a sequence, priced by a knapsack over the duals.
Patterns are rounded down, what is left is packed the largest first, short rests are counted by the token and
fill the room that patterns leave and then sequences of their own, and the pieces of each class, ranked over
the whole corpus, take the slots that the patterns hold for their class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.bpe import coding, default_vocabulary, each_text
from quillmesh.llm.common import documents, refuse_clash, settled

SIZE = 2048
END_ID = 1
#: tokens by which length classes differ; rests of at most this part of a sequence have classes of one token
GRAIN = 8
SHORT = 32
#: pieces that one window task ranks
RANKED_TOGETHER = 200_000


def token_pieces(docs: DataFrame, path: str, *, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents encoded, ended by ``end_id`` and cut every ``size`` tokens: one row per piece."""
    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        tail = int(end_id).to_bytes(4, "little")
        with coding(path) as coder:
            for whole in batches:
                for batch, texts in each_text(whole, 1):
                    row, start, length, crc, total, bodies = [], [], [], [], [], []
                    for k, text in enumerate(texts):
                        body = coder.encode(text) + tail
                        n = len(body) // 4
                        for at in range(0, n, size):
                            part = body[4 * at : 4 * (at + size)]
                            row.append(k)
                            start.append(at)
                            length.append(len(part) // 4)
                            crc.append(zlib.crc32(part))
                            total.append(n)
                            if with_ids:
                                bodies.append(np.frombuffer(part, "<u4").astype(np.int32))
                    arrays = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                    if with_ids:
                        arrays.append(pa.array(bodies, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(arrays, names=["i", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    ddl = f"i {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return slim.mapInArrow(run, ddl).withColumnRenamed("i", id_col)


def _best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: counts of the sizes that fit ``room`` with the highest value."""
    worth = np.full(room + 1, -np.inf)
    worth[sizes] = values
    best = np.zeros(room + 1)
    taken = np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        options = worth[1 : c + 1] + best[c - 1 :: -1]
        k = int(np.argmax(options))
        if options[k] > best[c - 1] + 1e-12:
            best[c], taken[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    counts = np.zeros(len(sizes), np.int64)
    place = np.zeros(room + 1, np.int64)
    place[sizes] = np.arange(len(sizes))
    c = room
    while c > 0:
        if taken[c]:
            counts[place[taken[c]]] += 1
            c -= int(taken[c])
        else:
            c -= 1
    return float(best[room]), counts


def cutting_stock(sizes: list[int], demand: list[int], room: int, rounds: int = 3000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: count}, times) that hold exactly ``demand`` pieces of each size.

    After ``rounds`` new columns the linear program is taken as it stands: the plan still holds every piece,
    with a little more padding.
    """
    size, need = np.array(sizes, np.int64), np.array(demand, np.float64)
    m = len(size)
    if not m:
        return []
    columns = np.diag(room // size).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(columns))
    level = inverse @ need
    for _ in range(rounds):
        value, counts = _best_pattern(inverse.sum(axis=0), size, room)
        if value <= 1 + 1e-7:
            break
        way = inverse @ counts
        up = way > 1e-9
        ratio = np.where(up, level / np.where(up, way, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        level = np.maximum(level - step * way, 0)
        level[out] = step
        columns[:, out] = counts
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    left = np.array(demand, np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-level, kind="stable"):
        counts = columns[:, k].astype(np.int64)
        held = counts > 0
        times = min(int(level[k] + 1e-6), int((left[held] // counts[held]).min()))
        if times > 0:
            left -= counts * times
            plan.append(({int(s): int(c) for s, c in zip(size[held], counts[held])}, times))
    order = np.argsort(-size)
    while left.any():  # what rounding leaves: a sequence at a time, the largest that fits first
        space, pattern = room, {}
        for k in order:
            c = int(min(left[k], space // size[k]))
            if c:
                pattern[int(size[k])] = c
                space -= c * int(size[k])
                left[k] -= c
        plan.append((pattern, 1))
    return plan


def class_of(length, size: int, grain: int):
    """The tokens that a piece counts for: its length if short, else the next multiple of the grain."""
    return F.when(length <= size // SHORT, length).otherwise(F.ceil(length / grain) * grain).cast("int")


def plan_of(histogram: dict[int, int], size: int, grain: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: count}, times) of all pieces, given how many each class has."""
    long = sorted(c for c in histogram if c > size // SHORT)
    stock = cutting_stock([c // grain for c in long], [histogram[c] for c in long], size // grain)
    left = {c: histogram[c] for c in sorted(histogram, reverse=True) if c <= size // SHORT}
    plan: list[tuple[dict[int, int], int]] = []

    def fill(pattern: dict[int, int], times: int | None) -> None:
        """The pattern's sequences (or as many as it takes) with short pieces, the largest first."""
        while times is None or times:
            space, more = size - sum(c * k for c, k in pattern.items()), {}
            for c, n in left.items():
                if k := min(n, space // c):
                    more[c] = k
                    space -= c * k
            if times is None and not more:
                return
            same = min([left[c] // k for c, k in more.items()] + [times] * (times is not None))
            for c, k in more.items():
                left[c] -= k * same
            plan.append((pattern | more, same))
            times = None if times is None else times - same

    for pattern, times in stock:
        fill({c * grain: k for c, k in pattern.items()}, times)
    fill({}, None)
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple]:
    """Per class: first rank, pieces per sequence, first sequence and first slot of each pattern that holds it."""
    out: dict[int, list] = {}
    upto: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for size, count in pattern.items():
            out.setdefault(size, []).append((upto.get(size, 0), count, sequence, slot))
            upto[size] = upto.get(size, 0) + count * times
            slot += count
        sequence += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in out.items()}


def ranked(pieces: DataFrame, by: str, keys: list[str], n: int) -> DataFrame:
    """Adds ``rank``, from 0 within each value of ``by`` over the whole table.

    Values are dealt into hash buckets, each ranked by itself, and buckets follow one another, so a
    value that most rows share is still ranked by many tasks.
    """
    buckets = max(8, -(-n // RANKED_TOGETHER))
    own = pieces.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = own.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, "_b").orderBy(*keys)
    out = own.withColumn("_k", F.row_number().over(inside)).join(counts, [by, "_b"])
    return out.withColumn("rank", F.col("_before") + F.col("_k") - 1).drop("_b", "_k", "_before")


def pack(docs: DataFrame, path: str, *, size: int = SIZE, end_id: int = END_ID, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most ``size`` tokens.

    Returned per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id and offset (and ids
    if asked for).  A null or empty text is the end token alone.  Repeated rows are packed as
    documents of their own, a null id as any other; columns besides id and text are not carried; an id
    column called as a returned one is refused with a ValueError.  An empty table gives an empty result.  Only the histogram reaches the driver: size / grain counts and
    size / SHORT for short pieces.
    """
    refuse_clash([id_col], ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "rank"])
    pieces = token_pieces(docs, path, size=size, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    pieces = settled(pieces.withColumns({"_class": class_of(F.col("length"), size, grain), "_row": F.monotonically_increasing_id()}))
    histogram = {r["_class"]: r["n"] for r in pieces.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan_of(histogram, size, grain))
    # a row's number decides its bucket and rank, so that rows which are equal throughout are spread as well
    placed = ranked(pieces, "_class", ["_row"], sum(histogram.values())).drop("_row")

    def place(batches):
        for batch in batches:
            classes = batch.column(batch.schema.get_field_index("_class")).to_numpy()
            ranks = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, slot = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
            for c in np.unique(classes):
                at = np.flatnonzero(classes == c)
                first, count, base, start = slots[int(c)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                inside = ranks[at] - first[k]
                sequence[at] = base[k] + inside // count[k]
                slot[at] = start[k] + inside % count[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], names=[*batch.schema.names, "sequence_id", "_slot"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", sequence_id long, _slot long"
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.mapInArrow(place, ddl).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_vocabulary())
