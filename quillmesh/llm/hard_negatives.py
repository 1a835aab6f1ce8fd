"""Operator 12, hard-negative mining with a vector-approximation file.

Candidates travel in blocks.  In a block each dimension is cut into cells of about equally many rows, and
a row is approximated by the numbers of its cells.  A table gives the least and the greatest value in
each cell; looked up by cell numbers, these bound every anchor's score from below and above.  Only
candidates whose bounds may enter a window, and come before what its list already holds, are scored exactly.

The plane of anchors by candidates is a grid whose cells are tasks: a row holds as many anchors as a task's
memory may, a column as many candidates as one task shall read.  It is swept twice: for the best rows of an
anchor's own label, and then, with a window of scores for each of these, for those of other labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, mix64, settled
from quillmesh.llm.vector_search import ASKING, _Cell, _matrices, _narrowed, _wide

#: bytes that a task holds for its anchors and their lists, and bytes of candidates that it reads
CELL_BYTES, COLUMN_BYTES = 256 << 20, 256 << 20
#: fewest columns, so that few rows still make several tasks
LEAST_COLUMNS = 8
#: rows of a block, and cells of a dimension in it
BLOCK, CELLS = 2048, 64
_FAR = (1 << 63) - 1
_GRID = pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("side", pa.int32()), ("kind", pa.string()), *[(x, pa.binary()) for x in ("ids", "labels", "body", "more", "codes", "marks")]])
_GRID_DDL = "dim int, place int, side int, kind string, ids binary, labels binary, body binary, more binary, codes binary, marks binary"
_FOUND = pa.schema([("i", pa.int64()), ("h", pa.int64()), ("j", pa.int32()), ("v", pa.int64()), ("s", pa.int64()), ("own", pa.bool_())])
_FOUND_DDL = "i long, h long, j int, v long, s long, own boolean"


def approximated(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell numbers of each row, least and greatest value in each cell of each dimension)."""
    n, dim = m.shape
    codes, marks = np.zeros((n, dim), np.uint8), np.zeros((2, dim, CELLS), m.dtype)
    ordered = np.sort(m, axis=0)
    for d in range(dim):
        column = ordered[:, d]
        cuts = np.unique(column[np.arange(1, CELLS) * n // CELLS])
        codes[:, d] = np.searchsorted(cuts, m[:, d], side="right")
        first = np.concatenate([[0], np.searchsorted(column, cuts)])
        last = np.append(first[1:], n)
        some = np.flatnonzero(last > first)
        marks[0, d, some], marks[1, d, some] = column[first[some]], column[last[some] - 1]
    return codes, marks


class Approximation:
    """A block's rows by their cells: bounds of inner products with any anchors."""

    def __init__(self, codes: np.ndarray, marks: np.ndarray):
        each = np.arange(codes.shape[1])
        low, high = marks[0][each, codes].astype(np.float64), marks[1][each, codes].astype(np.float64)
        self.twice_middle, self.width = low + high, high - low
        self.most = np.maximum(np.abs(low), np.abs(high)).max(initial=0)

    def bounds(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray] | None:
        """Twice the lower and the upper bounds; None where numbers pass what doubles hold."""
        # an anchor's positive components take a cell's least value for the lower bound, its negative ones the greatest
        q = q.astype(np.float64)
        limit = 4.04 * max(1.0, float(np.abs(q).sum(axis=1).max(initial=0))) * max(1.0, float(self.most))
        if not limit < 2.0**53:
            return None
        kind = np.float32 if limit < 2.0**24 else np.float64
        middle = q.astype(kind) @ self.twice_middle[rows].astype(kind).T
        slack = np.abs(q).astype(kind) @ self.width[rows].astype(kind).T
        return middle - slack, middle + slack


class _Lists(_Cell):
    """The ``k`` best of each slot, by score and then by the smaller id."""

    def __init__(self, k: int, slots: int):
        self.k, self.n = k, np.zeros(slots, np.int64)
        self.v, self.s = np.full((slots, k), _FAR), np.full((slots, k), -_FAR)


class _Anchors:
    """The anchors of one cell of the grid, by label, with ``width`` windows each."""

    def __init__(self, k: int, width: int, same: bool):
        self.k, self.width, self.same = k, width, same
        self.parts: list[tuple] = []
        self.lists: _Lists | None = None

    def ask(self, ids, labels, body, more) -> None:
        self.parts.append((ids, labels, body, more.reshape(len(ids), 1 + 2 * self.width)))

    def settle(self) -> None:
        ids, labels, body, more = (np.concatenate([p[x] for p in self.parts]) for x in range(4))
        self.parts = []
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.body, more = ids[order], labels[order], body[order], more[order]
        self.h, self.low, self.high = more[:, 0], more[:, 1 : 1 + self.width], more[:, 1 + self.width :]
        self.lists = _Lists(self.k, len(ids) * self.width)

    def offer(self, ids, labels, m, file: Approximation) -> None:
        """A block of candidates in order of label and id."""
        if not self.same:
            for a in range(0, len(self.ids), ASKING):
                self._tile(slice(a, min(a + ASKING, len(self.ids))), slice(0, len(ids)), ids, labels, m, file)
            return
        for label in np.intersect1d(self.labels, labels):
            b = slice(*np.searchsorted(labels, [label, label], side="left").tolist())
            b = slice(b.start, int(np.searchsorted(labels, label, side="right")))
            first, last = int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))
            for a in range(first, last, ASKING):
                self._tile(slice(a, min(a + ASKING, last)), b, ids, labels, m, file)

    def _tile(self, a: slice, b: slice, ids, labels, m, file) -> None:
        q, m, ids = self.body[a], m[b], ids[b]
        allowed = None if self.same else self.labels[a][:, None] != labels[b][None, :]
        count, width = a.stop - a.start, self.width
        shape = (count, width)
        slots = slice(a.start * width, a.stop * width)
        full = (self.lists.n[slots] == self.k).reshape(shape)
        floor = np.where(full, self.lists.s[slots, -1].reshape(shape), -_FAR)
        least, most = np.maximum(self.low[a], floor), self.high[a]
        bounds = file.bounds(q, b)
        possible = np.ones((count, len(ids)), bool) if bounds is None else np.zeros((count, len(ids)), bool)
        if bounds is not None:
            low, high = bounds
            edge = 2.0**24 if low.dtype == np.float32 else 2.0**53  # past all bounds, and exact in their type
            for j in range(width):
                possible |= (high >= np.clip(2.0 * least[:, j], -edge, edge).astype(low.dtype)[:, None]) & (low <= np.clip(2.0 * most[:, j], -edge, edge).astype(low.dtype)[:, None])
        if allowed is not None:
            possible &= allowed
        hits = int(np.count_nonzero(possible))
        if not hits:
            return
        top = 1.01 * max(1.0, float(np.abs(q.astype(np.float64)).sum(axis=1).max())) * max(1.0, float(np.abs(m.astype(np.float64)).max(initial=0)))
        if top < 2.0**50 / BLOCK and hits > possible.size // 8 and len(ids) > self.k:
            self._dense(a.start, q, m, ids, possible, least, most, np.float32 if top < 2.0**24 else np.float64)
            return
        rows, cols = np.nonzero(possible)
        for i in range(0, len(rows), 65_536):
            r, c = rows[i : i + 65_536], cols[i : i + 65_536]
            if top < 2.0**62:
                score = (q[r].astype(np.int64) * m[c].astype(np.int64)).sum(axis=1)
            else:  # exact at any size, then held to the ends of a long
                score = np.array([max(-_FAR, min(_FAR, x)) for x in (_wide(q[r]) * _wide(m[c])).sum(axis=1)], np.int64)
            for j in range(width):
                good = (score >= least[r, j]) & (score <= most[r, j])
                self.lists.keep((a.start + r[good]) * width + j, ids[c[good]], score[good])

    def _dense(self, begin: int, q, m, ids, possible, least, most, kind) -> None:
        """Many may enter: all scores at once, of which each window takes its ``k`` best by one partition."""
        score = (q.astype(kind) @ m.astype(kind).T).astype(np.int64)
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        key = score * BLOCK - place  # one number for score and id
        for j in range(self.width):
            good = possible & (score >= least[:, j, None]) & (score <= most[:, j, None])
            cols = np.argpartition(np.where(good, key, -_FAR), len(ids) - self.k, axis=1)[:, len(ids) - self.k :].reshape(-1)
            rows = np.repeat(np.arange(len(q)), self.k)
            some = good[rows, cols]
            rows, cols = rows[some], cols[some]
            self.lists.keep((begin + rows) * self.width + j, ids[cols], score[rows, cols])

    def found(self):
        """Batches of (anchor, window, candidate, score, whether it may be the anchor's own row)."""
        for i in range(0, len(self.lists.n), 65_536):
            n = self.lists.n[i : i + 65_536]
            filled = np.arange(self.k)[None, :] < n[:, None]
            slot = np.repeat(np.arange(i, i + len(n)), n)
            row, v, s = slot // self.width, self.lists.v[i : i + 65_536][filled], self.lists.s[i : i + 65_536][filled]
            own = np.zeros(len(row), bool)
            for x in np.flatnonzero((v == self.ids[row]) & self.same).tolist():
                own[x] = max(-_FAR, min(_FAR, sum(int(y) ** 2 for y in self.body[row[x]].tolist()))) == s[x]
            columns = self.ids[row], self.h[row], (slot % self.width).astype(np.int32), v, s, own
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_FOUND)


def _whole(batch: pa.RecordBatch, scale: float):
    """(row numbers, matrix of floor(scale * x)) for each length of vector."""
    numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(0)], names=["k", "e"])
    for dim, at, m in _matrices(numbered, False):
        with np.errstate(over="ignore"):
            yield dim, at, _narrowed(np.clip(np.floor(scale * m), -np.finfo(float).max, np.finfo(float).max))


def _grid_row(dim: int, place: int, side: int, ids, labels, m, more, codes, marks) -> pa.RecordBatch:
    row = (dim, place, side, m.dtype.str, ids.tobytes(), labels.tobytes(), m.tobytes(), more.tobytes(), codes.tobytes(), marks.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _GRID)], schema=_GRID)


def _blocks(rows: DataFrame, columns: int, scale: float) -> DataFrame:
    """Candidates (e, i, y) in blocks of rows in order of label and id, with their approximation."""

    def run(batches):
        none = np.zeros(0, np.int64)
        for batch in batches:
            ids, labels = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for dim, at, m in _whole(batch, scale):
                for a in range(0, len(at), BLOCK):
                    k = at[a : a + BLOCK]
                    order = np.lexsort((ids[k], labels[k]))
                    k, body = k[order], np.ascontiguousarray(m[a : a + BLOCK][order])
                    place = int(mix64(ids[k[:1]].view(U64) + U64(len(k)))[0] >> U64(33)) % columns
                    yield _grid_row(dim, place, 1, ids[k], labels[k], body, none, *approximated(body))

    return rows.select("e", "i", "y").mapInArrow(run, _GRID_DDL)


def _asking(anchors: DataFrame, n_rows: int, width: int, scale: float) -> DataFrame:
    """Anchors (e, i, y, h, w: least and greatest scores of their windows) in rows of the grid."""

    def run(batches):
        none = np.zeros(0, np.int64)
        for batch in batches:
            ids, labels, h = (batch.column(x).to_numpy() for x in (1, 2, 3))
            more = np.concatenate([h[:, None], batch.column(4).flatten().to_numpy().reshape(len(h), 2 * width)], axis=1) if len(h) else np.zeros((0, 1 + 2 * width), np.int64)
            for dim, at, m in _whole(batch, scale):
                row_of = (mix64(h[at].view(U64)) >> U64(20)) % U64(n_rows)
                for r in np.unique(row_of).tolist():
                    k = np.flatnonzero(row_of == r)
                    yield _grid_row(dim, r, 0, ids[at[k]], labels[at[k]], np.ascontiguousarray(m[k]), more[at[k]], none, none)

    return anchors.select("e", "i", "y", "h", "w").mapInArrow(run, _GRID_DDL)


def _swept(asking: DataFrame, blocks: DataFrame, n_rows: int, columns: int, *, k: int, width: int, same: bool) -> DataFrame:
    """The ``k`` best candidates of every window, with ``rank``, over the whole grid."""

    def run(batches):
        live, cell = None, None
        for batch in batches:
            for n, dim, side, kind, *parts in zip(*[x.to_pylist() for x in batch.columns]):
                if (n, dim) != live:
                    if cell is not None and cell.lists is not None:
                        yield from cell.found()
                    live, cell = (n, dim), _Anchors(k, width, same)
                ids, labels = (np.frombuffer(x, np.int64) for x in parts[:2])
                m = np.frombuffer(parts[2], np.dtype(kind)).reshape(len(ids), dim)
                if side == 0:
                    cell.ask(ids, labels, m, np.frombuffer(parts[3], np.int64))
                elif cell.parts or cell.lists is not None:
                    if cell.lists is None:
                        cell.settle()
                    codes = np.frombuffer(parts[4], np.uint8).reshape(len(ids), dim)
                    marks = np.frombuffer(parts[5], np.dtype(kind)).reshape(2, dim, CELLS)
                    cell.offer(ids, labels, m, Approximation(codes, marks))
        if cell is not None and cell.lists is not None:
            yield from cell.found()

    spread = asking.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("cell", F.col("place") * columns + F.col("_o"))
    spread = spread.unionByName(blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).withColumn("cell", F.col("_o") * columns + F.col("place")))
    spread = spread.select("cell", "dim", "side", "kind", "ids", "labels", "body", "more", "codes", "marks")
    found = spread.repartition(n_rows * columns, "cell").sortWithinPartitions("cell", "dim", "side").mapInArrow(run, _FOUND_DDL)
    best = Window.partitionBy("i", "h", "j").orderBy(F.col("s").desc(), "v")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, *, modulus: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_bytes: int = CELL_BYTES, column_bytes: int = COLUMN_BYTES) -> DataFrame:
    """Per anchor and positive, the best rows of other labels in the window of the positive's score.

    Returned: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.  Anchors
    are the rows whose id is divisible by ``modulus``; positives are an anchor's best other rows of its
    label; a negative's score lies between ``low`` and ``high`` hundredths of the positive's.  Scores are
    inner products of floor(scale * x), exact, and held to the ends of a long's range.  Rows with a null id
    or label (a whole number), or whose vector is null, empty or holds null or non-finite components take no
    part; vectors of different lengths are not compared.  Rows that repeat an id are rows of their own, even
    if equal throughout: each anchors, and each is the others' positive.  An anchor without positives, or a
    positive without negatives, has no rows; an empty table gives an empty result; other columns, whatever
    their names, are not carried.
    """
    fit = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("long").alias("y"), F.col(vector_col).alias("e"))
    rows = rows.filter(F.col("i").isNotNull() & F.col("y").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).filter(fit)
    asks = F.col("i") % modulus == 0
    size = rows.agg(F.count_if(asks).alias("n"), F.sum(F.when(asks, F.size("e"))).alias("b"), F.sum(F.size("e")).alias("all"), F.count("*").alias("rows")).first()
    held = 8 * int(size["b"] or 0) + (40 + positives * (32 + 16 * negatives)) * int(size["n"] or 0)
    n_rows = max(1, -(-held // cell_bytes))
    columns = max(LEAST_COLUMNS, -(-(3 * int(size["all"] or 0) + 16 * int(size["rows"] or 0)) // column_bytes))
    # equal anchors are asked for once, and counted
    anchors = settled(rows.filter(asks).groupBy("i", "y", "e").agg(F.count("*").alias("m")).withColumn("h", F.xxhash64("y", "e")))
    blocks = _blocks(rows, columns, scale)
    every = anchors.withColumn("w", F.array(F.lit(-_FAR), F.lit(_FAR)))
    found = _swept(_asking(every, n_rows, 1, scale), blocks, n_rows, columns, k=positives + 1, width=1, same=True)
    # one entry that equals the anchor's own row goes; if none is among the best, none has to
    best = F.sort_array(F.collect_list(F.struct("rank", "v", "s", "own")))
    own = F.array_position(F.transform("best", lambda x: x["own"]), True)
    others = F.filter("best", lambda x, k: k + 1 != own)
    chosen = found.groupBy("i", "h").agg(best.alias("best")).select("i", "h", F.slice(others, 1, positives).alias("best")).filter(F.size("best") > 0)
    chosen = settled(chosen)

    def windows(batches):
        for batch in batches:
            out = []
            for scores in batch.column(3).to_pylist():
                pairs = [(-((-low * p) // 100), high * p // 100) for p in scores]
                pairs = [(max(-_FAR, a), min(_FAR, b)) if a <= b else (_FAR, -_FAR) for a, b in pairs] + [(_FAR, -_FAR)] * (positives - len(scores))
                out.append([a for a, _ in pairs] + [b for _, b in pairs])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["i", "h", "m", "w"])

    picked = anchors.join(chosen, ["i", "h"])
    edges = picked.select("i", "h", "m", F.transform("best", lambda x: x["s"]).alias("p")).mapInArrow(windows, "i long, h long, m long, w array<long>").drop("m")
    asked = anchors.join(edges, ["i", "h"])
    found = _swept(_asking(asked, n_rows, positives, scale), blocks, n_rows, columns, k=negatives, width=positives, same=False)
    each = picked.withColumn("_m", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).select("i", "h", F.posexplode("best").alias("j", "p"))
    out = each.join(found.drop("own"), ["i", "h", "j"])
    return out.select(F.col("i").alias("anchor_id"), F.col("p.v").alias("positive_id"), "rank", F.col("v").alias("negative_id"), F.col("p.s").alias("positive_score"), F.col("s").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels, moved on by one where the id is divisible by 7, as wrong labels to mine."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
