"""Removal of repeated windows of words or lines, over a whole corpus.

Documents are dealt into blocks by a hash of their id, one exchange that is read again by each later
step.  What has to meet across blocks travels as packed arrays in rows (bucket, block): names of
recompression symbols first, then hashes of the windows that the symbols could not rule out.  A
bucket holds one range of hash values; each block sends a value once however often it holds it, so a
passage that a third of all documents share weighs as many entries as there are blocks.  Buckets
answer with one bit for each entry sent.  No row is dropped or capped anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import (
    U64,
    hash_spans,
    id_key,
    line_spans,
    refuse_clash,
    shards_for,
    slices,
    text_buffer,
    text_bytes,
    window_hashes,
    word_spans,
)
from quillmesh.llm.recompression import symbols

BLOCK_BYTES = 6 << 20
CHUNK_BYTES = 1 << 20
BUCKET_ENTRIES = 400_000
#: symbols shorter than this many words say little and are not sent
SYMBOL_WORDS = 3
_SENT = pa.schema([("to", pa.int64()), ("blk", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_SENT_DDL = "to long, blk long, n long, body binary"


class _Block:
    """The documents of one block in a fixed order, read chunk by chunk."""

    def __init__(self, table: pa.Table, kind: str):
        ids = id_key(table.column("_id"))
        order = np.lexsort((np.asarray(table.column("_h").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)), ids))
        self.table = table.take(pa.array(order)) if len(ids) > 1 else table
        self.ids = ids[order]
        self.data, self.offsets = text_buffer(self.table.column("_text"))
        self.known = np.asarray(self.table.column("_text").combine_chunks().is_valid())
        self.kind = kind

    def chunks(self):
        """(first row, rows, bytes, offsets, starts, ends, row of each unit) of each chunk."""
        spans = word_spans if self.kind == "words" else line_spans
        for i, j in slices(self.offsets, CHUNK_BYTES):
            base = self.offsets[i]
            data, offsets = self.data[base : self.offsets[j]], self.offsets[i : j + 1] - base
            starts, ends, rows = spans(data, offsets)
            if self.kind == "lines" and not self.known[i:j].all():
                live = self.known[i:j][rows]
                starts, ends, rows = starts[live], ends[live], rows[live]
            yield i, j, data, offsets, starts, ends, rows


def _split(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds in sorted 64-bit values of each of ``buckets`` equal ranges."""
    if buckets == 1:
        return np.array([0, len(values)])
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def remove_repeats(docs: DataFrame, *, unit: str = "words", window: int = 20, prefilter: bool = True, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes units covered by a window that also starts earlier in the corpus.

    A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) or lines of one document; it
    counts as repeated if the same sequence starts in a document of smaller id, or earlier in the
    same document.  All windows are judged on the input.  Returned per row: ``keep_columns`` (the id
    column by default), n_units, n_removed, kept_sha256 (of the kept words joined by one space, or
    lines by a line feed) and, if asked for, kept_text.

    A null text has no units and stays null; an empty text has no words, or one empty line.  A null
    id comes before all others.  Rows of the same id and start don't count as earlier than one
    another, so repeated rows of one id are kept alike.  Other columns are carried untouched; those
    called like an added one are refused with a ValueError.  An empty table gives an empty result.
    """
    refuse_clash(keep_columns or [id_col], ["n_units", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)
    total = text_bytes(docs, text_col)
    n_blocks = shards_for(total, block_bytes)
    mean_unit = 6 if unit == "words" else 200
    n_symbol = shards_for(int(total / mean_unit * 0.2), BUCKET_ENTRIES, 8)
    n_window = shards_for(int(total / mean_unit * 0.3), BUCKET_ENTRIES, 8)
    carried = keep_columns or [id_col]
    # all at once, so that the caller's columns may have any names
    text = F.col(text_col).cast("string")
    slim = docs.select(F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(n_blocks)).alias("_blk"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"), *[F.col(c).alias(f"c{i}_") for i, c in enumerate(carried)])
    kind = unit

    def named(block: _Block):
        """Per chunk: units, rows, and of the symbols fit to rule windows out: name, first and last start."""
        for i, j, data, offsets, starts, ends, rows in block.chunks():
            units = hash_spans(data, starts, ends)
            name = first = last = None
            if prefilter:
                name, length, lo, hi = symbols(units, rows)
                fit = (length >= SYMBOL_WORDS) & (hi - lo <= window) & (lo >= 0)
                name, first, last = name[fit], np.maximum(hi[fit] - window, 0), lo[fit]
            yield i, j, data, offsets, starts, ends, rows, units, name, first, last

    def send(bounds, blk: int, pack) -> pa.RecordBatch:
        rows = [(int(b), blk, int(bounds[b + 1] - bounds[b]), pack(bounds[b], bounds[b + 1])) for b in range(len(bounds) - 1) if bounds[b + 1] > bounds[b]]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows), _SENT)] if rows else [pa.array([], t.type) for t in _SENT], schema=_SENT)

    def block_symbols(block: _Block) -> tuple[np.ndarray, np.ndarray]:
        parts = [x[8] for x in named(block)]
        every = np.concatenate(parts) if parts else np.zeros(0, U64)
        return np.unique(every, return_counts=True)

    def reveal(key, table):
        """Names of this block's symbols, to the bucket of each."""
        values, counts = block_symbols(_Block(table, kind))
        bounds = _split(values, n_symbol)

        def pack(a, b):
            return values[a:b].tobytes()

        return pa.Table.from_batches([send(bounds, key[0].as_py(), pack)])

    def shared(key, table):
        """Which names of a bucket stand in more than one block."""
        bodies = [np.frombuffer(x.as_py(), U64) for x in table.column("body")]
        sizes = np.array([len(x) for x in bodies])
        every = np.concatenate(bodies)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = np.zeros(len(ranked), bool)
        same[1:] = ranked[1:] == ranked[:-1]
        same[:-1] |= same[1:]
        hit = np.zeros(len(ranked), bool)
        hit[order] = same
        return answer(table, sizes, hit)

    def answer(table: pa.Table, sizes: np.ndarray, hit: np.ndarray) -> pa.Table:
        ends = np.cumsum(sizes)
        bits = [np.packbits(hit[e - s : e]).tobytes() for s, e in zip(sizes, ends)]
        return pa.Table.from_arrays([table.column("to"), table.column("blk"), table.column("n"), pa.chunked_array([pa.array(bits, pa.binary())])], schema=_SENT)

    def told(replies: pa.Table, bounds: np.ndarray) -> np.ndarray:
        """The bits of all buckets, in the order of the values sent."""
        out = np.zeros(int(bounds[-1]), bool)
        for to, n, body in zip(replies.column("to").to_pylist(), replies.column("n").to_pylist(), replies.column("body").to_pylist()):
            if to >= 0:
                out[bounds[to] : bounds[to + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
        return out

    def candidates(block: _Block, replies: pa.Table | None) -> np.ndarray:
        """A mask of the windows (by start, over all units of the block) that may be repeated."""
        out = []
        if prefilter:
            values, counts = block_symbols(block)
            many = told(replies, _split(values, n_symbol)) | (counts > 1)
        for _, _, _, _, _, _, rows, units, name, first, last in named(block):
            m = len(units)
            alive = np.zeros(m, bool)
            if m >= window:
                alive[: m - window + 1] = rows[window - 1 :] == rows[: m - window + 1]
            if prefilter and len(name):
                once = ~many[np.searchsorted(values, name)]
                step = np.zeros(m + 1, np.int32)
                np.add.at(step, first[once], 1)
                np.add.at(step, last[once] + 1, -1)
                alive &= np.cumsum(step[:-1]) == 0
            out.append(alive)
        return np.concatenate(out) if out else np.zeros(0, bool)

    def keyed(block: _Block, alive: np.ndarray):
        """Hashes of the live windows in order, with row, place in its document and place in the block of each."""
        at, parts, before = 0, [], 0
        for i, j, data, _, starts, ends, rows in block.chunks():
            m = len(starts)
            live = np.flatnonzero(alive[at : at + m])
            if len(live):
                h, g = window_hashes(hash_spans(data, starts, ends), window)
                own = rows[live]
                parts.append((h[live], g[live], own.astype(np.int64) + i, live - np.searchsorted(rows, own), live + at))
            at += m
        if not parts:
            return np.zeros(0, U64), np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 3
        h, g, r, local, u = (np.concatenate(x) for x in zip(*parts))
        # rows are in order of id, so a stable sort puts the earliest of equal windows first
        order = np.argsort(h, kind="stable")
        ranked, other = h[order], g[order]
        if len(np.unique(block.ids)) < len(block.ids) or ((ranked[1:] == ranked[:-1]) & (other[1:] != other[:-1])).any():
            order = np.lexsort((local, block.ids[r], g, h))
        return h[order], g[order], r[order], local[order], u[order]

    def heads(h: np.ndarray, g: np.ndarray) -> np.ndarray:
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        return new

    def verify(key, left, right):
        """Hashes of live windows, once each, to their buckets; the mask itself back to the block."""
        if left.num_rows == 0:
            return pa.Table.from_arrays([pa.array([], t.type) for t in _SENT], schema=_SENT)
        block = _Block(left, kind)
        alive = candidates(block, right)
        h, g, r, _, _ = keyed(block, alive)
        at = np.flatnonzero(heads(h, g))
        h, g, ids = h[at], g[at], block.ids[r[at]]
        blk = key[0].as_py()

        def pack(a, b):
            return h[a:b].tobytes() + g[a:b].tobytes() + ids[a:b].tobytes()

        own = pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((-1 - blk, blk, len(alive), np.packbits(alive).tobytes()), _SENT)], schema=_SENT)
        return pa.Table.from_batches([send(_split(h, n_window), blk, pack), own])

    def earlier(key, table):
        """Which windows of a bucket also stand in a document of smaller id."""
        if key[0].as_py() < 0:
            return table.select(_SENT.names)
        ns = table.column("n").to_pylist()
        bodies = [x.as_buffer() for x in table.column("body")]
        h = np.concatenate([np.frombuffer(b, U64, n) for b, n in zip(bodies, ns)])
        g = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(bodies, ns)])
        ids = np.concatenate([np.frombuffer(b, np.int64, n, 12 * n) for b, n in zip(bodies, ns)])
        order = np.lexsort((ids, g, h))
        new = heads(h[order], g[order])
        lowest = ids[order][new][np.cumsum(new) - 1]
        hit = np.zeros(len(h), bool)
        hit[order] = ids[order] > lowest
        return answer(table, np.array(ns), hit)

    def finish(key, left, right):
        block = _Block(left, kind)
        alive = np.zeros(0, bool)
        for to, n, body in zip(right.column("to").to_pylist(), right.column("n").to_pylist(), right.column("body").to_pylist()):
            if to < 0:
                alive = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
        h, g, r, local, u = keyed(block, alive)
        new = heads(h, g)
        at = np.flatnonzero(new)
        past = told(right, _split(h[at], n_window))
        group = np.cumsum(new) - 1
        first = at[group]
        # equal windows of one block: later than the block's own earliest by id, or by place in one document
        same_start = (block.ids[r] == block.ids[r[first]]) & (local == local[first])
        flagged = u[past[group] | ~same_start]
        step = np.zeros(len(alive) + window + 1, np.int32)
        np.add.at(step, flagged, 1)
        np.add.at(step, flagged + window, -1)
        gone = np.cumsum(step)[: len(alive)] > 0
        units = np.zeros(len(block.ids), np.int64)
        removed = np.zeros(len(block.ids), np.int64)
        digests, texts, at = [], [], 0
        glue = b" " if kind == "words" else b"\n"
        for i, j, data, offsets, starts, ends, rows in block.chunks():
            m = len(starts)
            keep = ~gone[at : at + m]
            at += m
            units[i:j] = np.bincount(rows, minlength=j - i)
            removed[i:j] = np.bincount(rows[~keep], minlength=j - i)
            bounds = np.searchsorted(rows, np.arange(j - i + 1))
            body = data.tobytes()
            for k in range(j - i):
                a, b = bounds[k], bounds[k + 1]
                text = _joined(body, offsets[k], offsets[k + 1], starts[a:b], ends[a:b], keep[a:b], glue, kind)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode() if block.known[i + k] else None)
        columns = {c: block.table.column(f"c{i}_") for i, c in enumerate(carried)}
        arrays = list(columns.values()) + [pa.array(units), pa.array(removed), pa.array(digests, pa.string())]
        if with_text:
            arrays.append(pa.array(texts, pa.string()))
        return pa.Table.from_arrays(arrays, names=out_names)

    tail = ["n_units", "n_removed", "kept_sha256"] + (["kept_text"] if with_text else [])
    out_names = [f"c{i}_" for i in range(len(carried))] + tail
    ddl = ", ".join([f"c{i}_ {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried)] + ["n_units long", "n_removed long", "kept_sha256 string"] + (["kept_text string"] if with_text else []))
    by_block = slim.groupBy("_blk")
    if prefilter:
        sent = by_block.applyInArrow(reveal, _SENT_DDL)
        replies = sent.groupBy("to").applyInArrow(shared, _SENT_DDL)
        live = by_block.cogroup(replies.groupBy("blk")).applyInArrow(verify, _SENT_DDL)
    else:
        live = by_block.applyInArrow(lambda key, table: verify(key, table, None), _SENT_DDL)
    verdicts = live.groupBy("to").applyInArrow(earlier, _SENT_DDL)
    done = by_block.cogroup(verdicts.groupBy("blk")).applyInArrow(finish, ddl)
    return done.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(carried)], *tail)


def _joined(body: bytes, lo: int, hi: int, starts, ends, keep, glue: bytes, kind: str) -> bytes:
    """The kept units of one document joined by ``glue``."""
    if kind == "lines" and keep.all():
        return body[lo:hi]
    # neighbours that are kept and one glue byte apart are copied as one stretch
    at = np.flatnonzero(keep)
    if not len(at):
        return b""
    s, e = starts[at], ends[at]
    joint = np.zeros(len(at), bool)
    joint[1:] = (at[1:] == at[:-1] + 1) & (s[1:] == e[:-1] + 1)
    if kind == "words":
        g = glue[0]
        near = np.flatnonzero(joint)
        view = np.frombuffer(body, np.uint8)
        joint[near] = view[s[near] - 1] == g
    first = np.flatnonzero(~joint)
    last = np.append(first[1:], len(at)) - 1
    return glue.join([body[a:b] for a, b in zip(s[first].tolist(), e[last].tolist())])
