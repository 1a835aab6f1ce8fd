"""Operator 11, cross-tokenizer alignment by byte-owner arrays.

Every byte of a text is owned by one token of A and one of B: token numbers repeated over their bytes
give two arrays.  Where either changes, a run of one (A, B) pair ends: the runs are the overlaps.  Where
both change, the text can be cut; the cuts make the groups, and the two tokens before a cut are linked.
Whole slices of texts are aligned at once, since a text's end is a cut like others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.bpe import OffsetTable, each_text
from quillmesh.llm.byte_codec import byte_vocabulary, piece_vocabulary, public_path
from quillmesh.llm.common import documents, refuse_clash, written

#: pairs of ids up to which their counts are sent to every executor (some 20 bytes each); beyond, links are shuffled
SENT_PAIRS = 2_000_000
#: bits of a pair's number that hold the B id
B_BITS = 24
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Owners:
    """The tokens of both vocabularies over the joined bytes of some texts, and who owns each byte."""

    def __init__(self, a: np.ndarray, a_bytes: np.ndarray, b: np.ndarray, b_bytes: np.ndarray):
        self.a, self.b = a, b
        own_a, own_b = (np.repeat(np.arange(len(x), dtype=np.int32), n) for x, n in ((a, a_bytes), (b, b_bytes)))
        new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        end = len(own_a) - 1 if len(own_a) else 0
        last = np.append(np.flatnonzero(new_a | new_b), end)[: len(own_a)]
        #: the (A, B) pairs of tokens that share bytes, and where each pair's bytes end
        self.overlap_a, self.overlap_b, self.overlap_end = own_a[last], own_b[last], last + 1
        cut = np.append(np.flatnonzero(new_a & new_b), end)[: len(own_a)]
        #: the tokens whose bytes end at each cut, and the cuts
        self.cut_a, self.cut_b, self.cut_end = own_a[cut], own_b[cut], cut + 1

    def text(self, digits: OffsetTable) -> tuple[np.ndarray, np.ndarray]:
        """All groups written as ``a1,a2|b1;...``, and where each group's text ends, with its semicolon."""
        n_a, n_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        groups = np.arange(len(n_a))
        # a group's A tokens stand before its B tokens: each is moved by what the other side has before it
        at_a = np.arange(len(self.a)) + np.repeat((self.cut_b + 1 - n_b), n_a)
        at_b = np.arange(len(self.b)) + np.repeat((self.cut_a + 1), n_b)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        body, ends = digits.joined(ids)
        body[ends - 1] = ord(",")
        body[ends[at_a[self.cut_a]] - 1] = ord("|")
        stops = ends[at_b[self.cut_b]]
        body[stops - 1] = ord(";")
        return body, stops[groups]


def _numbers(items: list[bytes | None]) -> tuple[OffsetTable, np.ndarray]:
    """The bytes of each id in one buffer, and how many they are."""
    table = OffsetTable(items)
    return table, np.maximum(table.length - 1, 0)


def _joined(table: OffsetTable, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ids' bytes without spaces between."""
    n = length[ids]
    ends = np.cumsum(n)
    return table.buffer[np.repeat(table.start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Aligner:
    """Both vocabularies of a task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_vocabulary(a_path), piece_vocabulary(b_path)
        (self.a_table, self.a_length), (self.b_table, self.b_length) = _numbers(self.a.bytes_of), _numbers(self.b.bytes_of)
        self.digits = OffsetTable([str(i).encode() for i in range(max(len(self.a.bytes_of), len(self.b.bytes_of)))])

    def align(self, texts: list[str]) -> tuple[np.ndarray, Owners, np.ndarray, np.ndarray]:
        """(texts that align, their owners in one, numbers of A and of B tokens of every text)."""
        b_rows = self.b.ids(texts)
        kept, a_ids, b_ids = [], [], []
        n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            said = b" " + text.encode()
            b = np.array(b_rows[k], np.int64)
            if int(self.b_length[b].sum()) != len(said) or _joined(self.b_table, b, self.b_length).tobytes() != said:
                continue
            a = self.a.ids(" " + text, special=False).astype(np.int64)
            if int(self.a_length[a].sum()) != len(said) or _joined(self.a_table, a, self.a_length).tobytes() != said:
                continue
            kept.append(k)
            a_ids.append(a)
            b_ids.append(b)
            n_a[k], n_b[k] = len(a), len(b)
        none = np.zeros(0, np.int64)
        a, b = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
        return np.array(kept, np.int64), Owners(a, self.a_length[a], b, self.b_length[b]), n_a, n_b


def linked(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", overlaps: bool = False) -> DataFrame:
    """Per document: the id, n_a, n_b, n_groups, links (array<long>, A id * 2 ** 24 + B id) and groups_sha256.

    With ``overlaps`` also ``a_ids`` and ``b_ids``, the tokens, and ``overlap_a``, ``overlap_b`` and ``cuts``:
    the places of the tokens that share bytes and the byte offsets, in space and text, where both end.
    """
    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    lists = ["links", *["a_ids", "b_ids", "overlap_a", "overlap_b", "cuts"] * overlaps]

    def listed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))

    def run(batches):
        aligner = Aligner(a_path, b_path)
        for whole in batches:
            for batch, texts in each_text(whole, 1):
                kept, own, n_a, n_b = aligner.align(texts)
                # groups of each text: those whose last A token is one of its own
                first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
                row_of = np.searchsorted(np.cumsum(n_a[kept]), own.cut_a, side="right")
                n_groups = np.zeros(len(texts), np.int64)
                n_groups[kept] = np.bincount(row_of, minlength=len(kept))
                body, ends = own.text(aligner.digits)
                stops = np.concatenate([[0], ends[np.cumsum(n_groups[kept]) - 1]]) if len(kept) else np.zeros(1, np.int64)
                view, digest = memoryview(body), [""] * len(texts)
                for j, k in enumerate(kept.tolist()):
                    digest[k] = hashlib.sha256(view[int(stops[j]) : int(stops[j + 1]) - 1]).hexdigest()
                links = (own.a[own.cut_a] << B_BITS) | own.b[own.cut_b]
                arrays = [batch.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(digest, pa.string()), listed(links, n_groups)]
                if overlaps:
                    over = np.searchsorted(np.cumsum(n_a[kept]), own.overlap_a, side="right")
                    n_over = np.zeros(len(texts), np.int64)
                    n_over[kept] = np.bincount(over, minlength=len(kept))
                    begin = np.concatenate([[0], own.cut_end[np.cumsum(n_groups[kept]) - 1]])[:-1] if len(kept) else np.zeros(0, np.int64)
                    rest = (own.a, n_a), (own.b, n_b), (own.overlap_a - first_a[kept[over]], n_over), (own.overlap_b - first_b[kept[over]], n_over), (own.cut_end - begin[row_of], n_groups)
                    arrays += [listed(*x) for x in rest]
                yield pa.RecordBatch.from_arrays(arrays, names=["i", "n_a", "n_b", "n_groups", "groups_sha256", *lists])

    ddl = f"i {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, " + ", ".join(f"{c} array<long>" for c in lists)
    return slim.mapInArrow(run, ddl).withColumnRenamed("i", id_col)


def pair_counts(links: DataFrame) -> DataFrame:
    """Per linked pair: ``pair``, ``n`` links of the whole corpus and ``best``, whether no pair of its B id has more."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1)))
    return counts.withColumn("best", (F.col("n") == top).cast("long"))


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Per document: the id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    A text that is null, empty, or that the tokens' bytes do not give back has no tokens: zeros and ''.
    Repeated rows and null ids are documents like others.  Columns besides id and text are not carried; an
    id column called as a returned one is refused with a ValueError.  An empty table gives an empty result.
    Texts are encoded once; their links are written to the shared folder and read for the counts and for the
    sums.  Counts of up to ``sent_pairs`` pairs are broadcast; of more, links are summed per document and
    pair and shuffled to the counts.
    """
    refuse_clash([id_col], [*RESULTS, "links", "pair", "n", "best", "_row"])
    rows = written(linked(docs, a_path, b_path, id_col=id_col, text_col=text_col).withColumn("_row", F.monotonically_increasing_id()), "alignment-links")
    links = rows.select("_row", F.explode("links").alias("pair"))
    counts = written(pair_counts(links), "alignment-counts")
    if counts.count() <= sent_pairs:
        scored = links.withColumn("_k", F.lit(1)).join(F.broadcast(counts), "pair")
    else:
        scored = links.groupBy("_row", "pair").agg(F.count("*").alias("_k")).join(counts, "pair")
    sums = scored.groupBy("_row").agg(F.sum("_k").alias("n_links"), F.sum(F.col("best") * F.col("_k")).alias("n_best"), F.sum(F.col("n") * F.col("_k")).alias("count_sum"))
    out = rows.drop("links").join(sums, "_row", "left")
    whole = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in ("n_links", "n_best", "count_sum") else F.col(c) for c in RESULTS]
    return out.select(id_col, *whole)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
