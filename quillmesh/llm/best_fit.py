"""Operator 13, best-fit packing: best-two-fit over the exact histogram of lengths.

A sequence is filled greedily, the longest document that fits first.  Then its smallest document gives
way to two unpacked ones, if two fit the expanded gap more tightly.  Small documents are what closes the
last gaps, so a gap of a few tokens is left alone; how many, is chosen by planning with several values
and keeping the plan of the fewest sequences.  Documents of one length are alike, so the driver plans on at most one count per length, whatever the corpus: a filled sequence is a pattern
of lengths, and is used as often as its lengths last.  The pieces of each length, ranked over the whole
corpus, take the slots that the patterns hold for it; a slot's offset follows from its pattern alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.bpe import each_text
from quillmesh.llm.byte_codec import byte_vocabulary, public_path
from quillmesh.llm.common import documents, refuse_clash, settled
from quillmesh.llm.packing import ranked

SIZE, END_ID = 1024, 2
#: gaps, in tokens, up to which a sequence is left as it was filled
TIGHT = (0, 1, 2, 4, 8, 16, 32)


def whole_pieces(docs: DataFrame, path: str, *, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Documents encoded and ended; only longer ones are cut, into full pieces after a first one that may be shorter."""
    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        coder = byte_vocabulary(path)
        for whole in batches:
            for batch, texts in each_text(whole, 1):
                row, piece, start, length, crc, bodies = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = np.append(coder.ids(text, special=True), np.uint32(end_id)).astype("<u4")
                    body, n = ids.tobytes(), len(ids)
                    first = (n - 1) % size + 1
                    for j, at in enumerate([0, *range(first, n, size)]):
                        part = body[4 * at : 4 * (at + size if j else first)]
                        row.append(k)
                        piece.append(j)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            bodies.append(np.frombuffer(part, "<u4").astype(np.int32))
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                if with_ids:
                    arrays.append(pa.array(bodies, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["i", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    ddl = f"i {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return slim.mapInArrow(run, ddl).withColumnRenamed("i", id_col)


def _greedy(left: np.ndarray, room: int) -> dict[int, int]:
    """{length: how many} of a sequence filled with the longest that fits, again and again."""
    below = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
    pattern: dict[int, int] = {}
    space, c = room, int(below[room])
    while c:
        k = int(min(left[c], space // c))
        pattern[c] = k
        space -= c * k
        c = int(below[min(space, c - 1)])
    return pattern


def _best_two(left: np.ndarray, gap: int) -> tuple[int, int]:
    """The two unpacked lengths (the shorter first) of the largest sum that fits the gap; zeros if none do."""
    some = left[: gap + 1] > 0
    below = np.maximum.accumulate(np.where(some, np.arange(len(some)), 0))
    a = np.flatnonzero(some)
    a = a[2 * a <= gap]
    if not len(a):
        return 0, 0
    b = below[gap - a]
    good = (b > a) | ((b == a) & (left[a] > 1))
    if not good.any():
        return 0, 0
    a, b = a[good], b[good]
    k = int(np.argmax(a + b))  # of equal sums the one with the longest document
    return int(a[k]), int(b[k])


def best_two_fit(histogram: dict[int, int], room: int, tight: int = 0) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how many}, times) that hold every document of the histogram once.

    Choices depend on which lengths remain and on how many of them only as far as a sequence holds them, so a
    pattern is repeated while its lengths last; there are at most some thousand patterns.
    """
    left = np.zeros(room + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    plan: list[tuple[dict[int, int], int]] = []
    while left.any():
        pattern = _greedy(left, room)
        while sum(pattern.values()) > 1:
            smallest = min(pattern)
            space = room - sum(c * k for c, k in pattern.items())
            if space <= tight:
                break
            unpacked = left.copy()
            for c, k in pattern.items():
                unpacked[c] -= k
            a, b = _best_two(unpacked, space + smallest)
            if a + b <= smallest:
                break
            pattern[smallest] -= 1
            for c in (a, b):
                pattern[c] = pattern.get(c, 0) + 1
            pattern = {c: k for c, k in sorted(pattern.items(), reverse=True) if k}
        times = min(int(left[c]) // k for c, k in pattern.items())
        for c, k in pattern.items():
            left[c] -= k * times
        plan.append((pattern, times))
    return plan


def fewest(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """The plan of the fewest sequences over the values of TIGHT."""
    return min((best_two_fit(histogram, room, tight) for tight in TIGHT), key=lambda plan: sum(times for _, times in plan))


def slots_of(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple]:
    """Per length: first rank, documents per sequence, first sequence and first offset of each pattern that holds it."""
    out: dict[int, list] = {}
    upto: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, count in pattern.items():
            out.setdefault(length, []).append((upto.get(length, 0), count, sequence, offset))
            upto[length] = upto.get(length, 0) + count * times
            offset += count * length
        sequence += times
    return {c: tuple(np.array(x, np.int64) for x in zip(*rows)) for c, rows in out.items()}


def best_fit_pack(docs: DataFrame, path: str, *, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs documents, cut only where longer than ``size`` tokens, into few sequences of at most ``size``.

    Returned per piece: the id, piece, start, length, ids_crc32, sequence_id and offset (and ids if asked
    for).  A null or empty text is the end token alone.  Repeated rows are packed as documents of their
    own, a null id as any other.  Columns besides id and text are not carried; an id column called as a
    returned one is refused with a ValueError.  An empty table gives an empty result.  Only the
    histogram, ``size`` counts, reaches the driver.
    """
    refuse_clash([id_col], ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids", "rank", "_row"])
    pieces = whole_pieces(docs, path, size=size, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    pieces = settled(pieces.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(fewest(histogram, size))
    # a row's number decides its bucket and rank, so that rows which are equal throughout are spread as well
    placed = ranked(pieces, "length", ["_row"], sum(histogram.values())).drop("_row")

    def place(batches):
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            ranks = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for c in np.unique(lengths):
                at = np.flatnonzero(lengths == c)
                first, count, base, begin = slots[int(c)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                inside = ranks[at] - first[k]
                sequence[at] = base[k] + inside // count[k]
                offset[at] = begin[k] + inside % count[k] * c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", sequence_id long, offset long"
    return placed.mapInArrow(place, ddl).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir), public_path("byte_bpe_50k.json"))
