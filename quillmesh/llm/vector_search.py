"""Operators 6 and 8: exact top-k and nearest neighbours by tiles of a query-by-candidate grid.

The plane of queries by candidates is cut into cells.  A query goes to one row and all columns, a
block of candidates to one column and all rows, both in the narrowest type that holds them.  A row
has as many queries as one task's memory may hold, so there are few rows and candidates travel few
times; a cell keeps its queries and lets the candidates stream by in tiles.  Each tile is a matrix
product from which every query selects a few; the lists of a row are merged by a tree over columns.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillmesh.llm.common import U64, mix64

#: bytes that a cell holds for its queries and their lists
CELL_BYTES = 256 << 20
#: bytes of candidates that a cell reads, and fewest columns, so that few candidates still make several tasks
COLUMN_BYTES, COLUMNS = 256 << 20, 12
#: candidates of one block on the way, and the sides of a tile
CANDIDATES, TILE, ASKING = 1024, 2048, 1024
#: queries whose lists travel together, and lists that one step of the tree merges
TOGETHER = 4096
FAN = 8
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_BLOCK_DDL = "dim int, place int, side int, kind string, ids binary, body binary"
_LISTS = pa.schema([("dim", pa.int32()), ("r", pa.int32()), ("s", pa.int32()), ("c", pa.int32()), ("wide", pa.bool_()), *[(x, pa.binary()) for x in ("q", "h", "m", "own", "z", "v", "score")]])
_LISTS_DDL = "dim int, r int, s int, c int, wide boolean, q binary, h binary, m binary, own binary, z binary, v binary, score binary"


def _matrices(batch: pa.RecordBatch, nonzero: bool):
    """(ids, matrix of doubles) of the valid vectors of each length."""
    ids, column = batch.column(0), batch.column(1)
    valid = np.asarray(ids.is_valid()) & np.asarray(column.is_valid())
    ids, column = ids.filter(pa.array(valid)).to_numpy().astype(np.int64), column.filter(pa.array(valid))
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    size = np.asarray(pa.compute.list_value_length(column)).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        m = values[(start[at][:, None] + np.arange(dim)).reshape(-1)].reshape(len(at), dim)
        good = np.isfinite(m).all(axis=1)
        if nonzero:
            good &= (m != 0).any(axis=1)
        if good.any():
            yield dim, ids[at[good]], m[good]


def _narrowed(m: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them all; doubles past 32 bits."""
    top = np.abs(m).max(initial=0)
    for kind, limit in ((np.int8, 127), (np.int16, 32_767), (np.int32, 2**31 - 1)):
        if top <= limit:
            return m.astype(kind)
    return m


def _names(ids: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's id and vector."""
    words = np.ascontiguousarray(m, np.float64) + 0.0
    h = mix64(ids.view(U64) + U64(0x9E3779B97F4A7C15))
    for column in words.view(U64).T:
        h = mix64(h ^ column)
    return h.view(np.int64)


def _integers(m: np.ndarray) -> np.ndarray:
    """floor(64 x) of each component; a product past the doubles' range is held to their largest."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(64.0 * m), -np.finfo(float).max, np.finfo(float).max)


def _quantised(m: np.ndarray):
    """Unit vectors in 8 bits: codes, scale and the length of what rounding leaves."""
    unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    rest = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, rest


def _tamed(m: np.ndarray) -> np.ndarray:
    """Very large or small vectors scaled by a power of two, which leaves cosines as they are."""
    m = m.astype(np.float64)
    top = np.abs(m).max(axis=1)
    wild = (top > 1e100) | (top < 1e-100)
    if wild.any():
        m[wild] = np.ldexp(m[wild], -np.frexp(top[wild])[1][:, None])
    return m


def _wide(m: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in m.reshape(-1).tolist()], object).reshape(m.shape)


def _first(row: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score first, ties to the smaller id."""
    if s.dtype == object:
        order = np.array(sorted(range(len(s)), key=lambda i: (row[i], -s[i], v[i])), np.int64)
    else:
        order = np.lexsort((v, -s, row))
    row = row[order]
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
    return order[rank < k]


class _Cell:
    """The queries of one cell and the ``k`` best of each among the candidates met so far."""

    def __init__(self, k: int):
        self.k = k
        self.asked: list[tuple] = []
        self.ready = False

    def ask(self, ids: np.ndarray, m: np.ndarray) -> None:
        self.asked.append((ids, m))

    def settle(self) -> None:
        """Equal queries become one, with how many they are; all in an order that every column shares."""
        self.ready = True
        ids, m = np.concatenate([x for x, _ in self.asked]), np.concatenate([x for _, x in self.asked])
        self.asked = []
        names = _names(ids, m)
        order = np.lexsort((names, ids))
        ids, names = ids[order], names[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])
        at = np.flatnonzero(new)
        self.q, self.h, self.m = ids[at], names[at], np.diff(np.append(at, len(ids)))
        self.body = m[order[at]]
        self.n = np.zeros(len(at), np.int64)
        self.v = np.full((len(at), self.k), _HIGH)
        self.own = np.zeros(len(at))
        self.prepare()

    def keep(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes scored candidates into the lists of their queries."""
        if not len(rows):
            return
        some = np.unique(rows)
        filled = np.arange(self.k)[None, :] < self.n[some][:, None]
        row = np.concatenate([np.repeat(some, self.n[some]), rows])
        v = np.concatenate([self.v[some][filled], ids])
        s = np.concatenate([self.s[some][filled], score])
        best = _first(row, v, s, self.k)
        row, v, s = row[best], v[best], s[best]
        head = np.searchsorted(row, some)
        place = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
        self.v[row, place], self.s[row, place] = v, s
        self.n[some] = np.bincount(np.searchsorted(some, row), minlength=len(some))

    def offer(self, ids: np.ndarray, m: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        for i in range(0, len(ids), TILE):
            self.tile(ids[i : i + TILE], m[i : i + TILE])

    def lists(self, select: np.ndarray):
        filled = np.arange(self.k)[None, :] < self.n[select][:, None]
        return self.q[select], self.h[select], self.m[select], self.own[select], self.n[select], self.v[select][filled], self.s[select][filled]


class _Products(_Cell):
    """Integer inner products, exact at any size."""

    def prepare(self) -> None:
        self.s = np.full((len(self.q), self.k), _LOW)
        wide = self.body.astype(np.float64)
        self.weight = np.abs(wide).sum(axis=1)
        self.own = np.zeros(len(self.q), np.int64)
        for i in range(0, len(self.q), ASKING):
            part = wide[i : i + ASKING]
            most = float((np.abs(part).max(axis=1, initial=0) * self.weight[i : i + ASKING]).max())
            if most < 2.0**53:
                self.own[i : i + ASKING] = (part * part).sum(axis=1)
            else:
                exact = _wide(part)
                own = (exact * exact).sum(axis=1)
                if max(own) > _HIGH and self.own.dtype != object:
                    self.own, self.s = self.own.astype(object), self.s.astype(object)
                self.own[i : i + ASKING] = own

    def tile(self, ids: np.ndarray, m: np.ndarray) -> None:
        top = float(np.abs(m.astype(np.float64)).max(initial=0))
        for i in range(0, len(self.q), ASKING):
            j = min(i + ASKING, len(self.q))
            bound = 1.001 * max(1.0, float(self.weight[i:j].max())) * max(1.0, top)  # factors of one, so that each side fits the type as well
            kind = np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64 if bound < 2.0**62 else object
            if kind is object:
                score = _wide(self.body[i:j]) @ _wide(m).T
                if self.s.dtype != object:
                    self.s = self.s.astype(object)
            else:
                score = self.body[i:j].astype(kind) @ m.astype(kind).T
            full = self.n[i:j] == self.k
            floor = self.s[i:j, -1]
            hit = np.ones(score.shape, bool) if not full.any() else (score >= floor[:, None]).astype(bool) | ~full[:, None]
            if kind in (np.float32, np.float64) and bound < 2.0**50 / TILE and np.count_nonzero(hit) > 4 * self.k * (j - i) and len(ids) > self.k:
                # one number for score and place, so that ties fall to the smaller id
                key = score.astype(np.int64) * TILE - np.arange(len(ids))
                cols = np.argpartition(key, len(ids) - self.k, axis=1)[:, len(ids) - self.k :].reshape(-1)
                rows = np.repeat(np.arange(j - i), self.k)
                some = hit[rows, cols]
                rows, cols = rows[some], cols[some]
            else:
                rows, cols = np.nonzero(hit)
            found = score[rows, cols]
            found = found if kind is object else found.astype(np.int64)
            better = ~full[rows] | (found > floor[rows]).astype(bool) | (ids[cols] < self.v[i:j, -1][rows])
            self.keep(rows[better] + i, ids[cols[better]], found[better])


class _Cosines(_Cell):
    """Cosines: 8-bit tiles with error bounds rule out, doubles decide."""

    def prepare(self) -> None:
        self.s = np.full((len(self.q), self.k), -np.inf)
        n = len(self.q)
        self.code = np.empty(self.body.shape, np.int8)
        self.scale, self.rest, self.length, self.own = (np.empty(n) for _ in range(4))
        for i in range(0, n, ASKING):
            part = _tamed(self.body[i : i + ASKING])
            j = i + len(part)
            self.code[i:j], self.scale[i:j], self.rest[i:j] = _quantised(part)
            self.length[i:j] = np.sqrt((part * part).sum(axis=1))
            self.own[i:j] = (part * part).sum(axis=1) / (self.length[i:j] * self.length[i:j])

    def tile(self, ids: np.ndarray, m: np.ndarray) -> None:
        m = _tamed(m)
        length = np.sqrt((m * m).sum(axis=1))
        code, scale, rest = _quantised(m)
        # products of codes are whole numbers below 2 ** 24 up to 1,040 components, so floats hold them
        kind = np.float32 if m.shape[1] <= 1040 else np.float64
        code = code.astype(kind).T
        for i in range(0, len(self.q), ASKING):
            j = min(i + ASKING, len(self.q))
            near = (self.code[i:j].astype(kind) @ code) * self.scale[i:j, None] * scale[None, :]
            slack = self.rest[i:j, None] * (1 + rest[None, :]) + rest[None, :] + 1e-6
            limit = np.where(self.n[i:j] == self.k, self.s[i:j, -1], -np.inf)
            if len(ids) > self.k:
                low = near - slack
                limit = np.maximum(limit, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            rows, cols = np.nonzero(near + slack >= limit[:, None])
            if not len(rows):
                continue
            own = _tamed(self.body[i:j])
            score = np.empty(len(rows))
            for a in range(0, len(rows), 65_536):
                r, c = rows[a : a + 65_536], cols[a : a + 65_536]
                score[a : a + 65_536] = (own[r] * m[c]).sum(axis=1) / (self.length[i + r] * length[c])
            better = (self.n[i:j][rows] < self.k) | (score > self.s[i:j, -1][rows]) | ((score == self.s[i:j, -1][rows]) & (ids[cols] < self.v[i:j, -1][rows]))
            self.keep(rows[better] + i, ids[cols[better]], score[better])


def _packed(dim: int, r: int, s: int, c: int, lists: tuple) -> pa.RecordBatch:
    q, h, m, own, z, v, score = lists
    wide = own.dtype == object or score.dtype == object
    said = [" ".join(map(str, x.tolist())).encode() if wide else x.tobytes() for x in (own, score)]
    row = (dim, r, s, c, wide, *[x.astype(np.int64).tobytes() for x in (q, h, m)], said[0], *[x.astype(np.int64).tobytes() for x in (z, v)], said[1])
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _LISTS)], schema=_LISTS)


def _opened(row: dict, kind) -> tuple:
    q, h, m, z, v = (np.frombuffer(row[x], np.int64) for x in ("q", "h", "m", "z", "v"))
    own, score = (np.array([int(x) for x in row[c].split()], object) if row["wide"] else np.frombuffer(row[c], kind) for c in ("own", "score"))
    return q, h, m, own, z, v, score


def _merged(parts: list[tuple], k: int, heaps: bool) -> tuple:
    """The k best of each query over several lists, by heaps or by one sort."""
    wide = any(p[6].dtype == object or p[3].dtype == object for p in parts)
    q, h, m, own, z = (np.concatenate([p[i].astype(object) if wide and i == 3 else p[i] for p in parts]) for i in range(5))
    v, score = np.concatenate([p[5] for p in parts]), np.concatenate([p[6].astype(object) if wide else p[6] for p in parts])
    order = np.lexsort((h, q))
    new = np.ones(len(q), bool)
    new[1:] = (q[order][1:] != q[order][:-1]) | (h[order][1:] != h[order][:-1])
    group = np.empty(len(q), np.int64)
    group[order] = np.cumsum(new) - 1
    at = order[new]
    if heaps:
        begin = np.concatenate([[0], np.cumsum(z)])
        runs: list[list[int]] = [[] for _ in range(len(at))]
        for i, g in enumerate(group.tolist()):
            runs[g].append(i)
        lows, places = (-score).tolist(), v.tolist()
        kept, sizes = [], []
        for own_runs in runs:
            streams = [zip(lows[begin[i] : begin[i + 1]], places[begin[i] : begin[i + 1]], range(begin[i], begin[i + 1])) for i in own_runs]
            best = [x[2] for x in islice(heapq.merge(*streams), k)]
            kept += best
            sizes.append(len(best))
        kept, sizes = np.array(kept, np.int64), np.array(sizes, np.int64)
    else:
        row = np.repeat(group, z)
        kept = _first(row, v, score, k)
        sizes = np.bincount(row[kept], minlength=len(at))
    return q[at], h[at], m[at], own[at], sizes, v[kept], score[kept]


def _answers(lists: tuple, k: int):
    """(query_id, rank, vec_id, score) with each query's own row taken out, for every row that asked."""
    q, _, m, own, z, v, score = lists
    row = np.repeat(np.arange(len(q)), z)
    mine = np.flatnonzero(v == q[row])
    gap = np.abs(score[mine] - own[row[mine]])
    same = gap <= 1e-12 if score.dtype == np.float64 else (gap == 0).astype(bool)
    mine, gap = mine[same], gap[same]
    mine = mine[np.lexsort((gap.astype(np.float64), row[mine]))]
    once = np.ones(len(mine), bool)
    once[1:] = row[mine][1:] != row[mine][:-1]
    keep = np.ones(len(row), bool)
    keep[mine[once]] = False
    row, v, score = row[keep], v[keep], score[keep]
    head = np.searchsorted(row, row)
    rank = np.arange(len(row)) - head + 1
    row, v, score, rank = row[rank <= k], v[rank <= k], score[rank <= k], rank[rank <= k]
    if score.dtype == object:
        score = np.array([max(_LOW, min(_HIGH, x)) for x in score], np.int64)
    for again in range(int(m.max(initial=0))):
        live = m[row] > again
        yield pa.RecordBatch.from_arrays([pa.array(q[row[live]]), pa.array(rank[live].astype(np.int32)), pa.array(v[live]), pa.array(score[live])], names=["query_id", "rank", "vec_id", "score"])


def grid_search(vectors: DataFrame, *, modulus: int, k: int, measure: str, id_col: str = "vec_id", vector_col: str = "embedding", cell_bytes: int = CELL_BYTES, columns: int | None = None) -> DataFrame:
    """Each query's k best among all other rows: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``modulus``.  ``measure`` is "product" (inner product
    of floor(64 x), long) or "cosine" (double).  Vectors that are null or hold null or non-finite
    components take no part, nor do rows with a null id and, for cosines, zero vectors.  Vectors of
    different lengths are not compared.  Every row is a query and a candidate of its own: rows that
    repeat an id, or an id and its vector, each get a list and each have a place in others' lists and in
    one another's.  A query without candidates has no rows; an empty table gives an empty result; other
    columns, whatever their names, are not carried.  Products are ranked by their exact value; only what
    is shown of one past a long is held to the ends of its range.

    A cell holds its queries, up to ``cell_bytes`` with their lists, and reads about COLUMN_BYTES of candidates.
    """
    whole = measure == "product"
    kind = np.int64 if whole else np.float64
    each = 2 if whole else 5 if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else 9
    slim = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("e"))
    asks = F.col("i") % modulus == 0
    size = slim.agg(F.count_if(asks).alias("n"), F.sum(F.when(asks & F.col("e").isNotNull(), F.size("e"))).alias("b"), F.sum(F.when(F.col("e").isNotNull(), F.size("e"))).alias("all")).first()
    # as many columns as keep what one cell reads bounded, whatever the number of candidates
    columns = columns or max(COLUMNS, -(-each * int(size["all"] or 0) // COLUMN_BYTES))
    held = each * int(size["b"] or 0) + (40 + 16 * (k + 1)) * int(size["n"] or 0)
    n_rows = max(1, -(-held // cell_bytes))
    n_together = max(1, -(-int(size["n"] or 0) // n_rows // TOGETHER))

    def blocks(batches):
        for batch in batches:
            rows: list[tuple] = []
            for dim, ids, m in _matrices(batch, not whole):
                m = _narrowed(_integers(m)) if whole else m.astype(np.float32) if each == 5 else m
                for a in range(0, len(ids), CANDIDATES):
                    part, body = ids[a : a + CANDIDATES], m[a : a + CANDIDATES]
                    place = int(mix64(part[:1].view(U64) + U64(a + len(part)))[0] >> U64(33)) % columns
                    rows.append((dim, place, 1, body.dtype.str, part.tobytes(), body.tobytes()))
                own = np.flatnonzero(ids % modulus == 0)
                row_of = (_names(ids[own], m[own]).view(U64) >> U64(20)) % U64(n_rows)
                for r in np.unique(row_of).tolist():
                    at = own[row_of == r]
                    rows.append((dim, r, 0, m.dtype.str, ids[at].tobytes(), m[at].tobytes()))
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x]) if i > 2 else pa.array([x], pa.int32()) for i, x in enumerate(row)], names=["dim", "place", "side", "kind", "ids", "body"])

    def cells(batches):
        live, cell = None, None

        def close():
            if cell is not None and cell.ready:
                shares = (cell.h.view(U64) >> U64(8)) % U64(n_together)
                for s in np.unique(shares).tolist():
                    yield _packed(live[1], live[0] // columns, s, live[0] % columns, cell.lists(np.flatnonzero(shares == s)))

        for batch in batches:
            for n, dim, side, form, ids, body in zip(*[x.to_pylist() for x in batch.columns]):
                if (n, dim) != live:
                    yield from close()
                    live, cell = (n, dim), (_Products if whole else _Cosines)(k + 1)
                ids, form = np.frombuffer(ids, np.int64), np.dtype(form)
                m = np.frombuffer(body, form).reshape(len(ids), dim)
                if side == 0:
                    cell.ask(ids, m)
                elif cell.asked or cell.ready:
                    if not cell.ready:
                        cell.settle()
                    cell.offer(ids, m)
        yield from close()

    def merge(key, table):
        parts = [_opened(row, kind) for row in table.to_pylist()]
        return pa.Table.from_batches([_packed(*[x.as_py() for x in key], _merged(parts, k + 1, not whole))])

    spread = slim.mapInArrow(blocks, _BLOCK_DDL)
    other = F.when(F.col("side") == 0, F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(F.sequence(F.lit(0), F.lit(n_rows - 1)))
    spread = spread.withColumn("other", F.explode(other))
    spread = spread.select(F.when(F.col("side") == 0, F.col("place") * columns + F.col("other")).otherwise(F.col("other") * columns + F.col("place")).alias("cell"), "dim", "side", "kind", "ids", "body")
    lists = spread.repartition(n_rows * columns, "cell").sortWithinPartitions("cell", "dim", "side").mapInArrow(cells, _LISTS_DDL)
    left = columns
    while left > 1:
        lists = lists.withColumn("c", F.floor(F.col("c") / FAN).cast("int")).groupBy("dim", "r", "s", "c").applyInArrow(merge, _LISTS_DDL)
        left = -(-left // FAN)

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _answers(_opened(row, kind), k)

    return lists.mapInArrow(rows, f"query_id long, rank int, vec_id long, score {'long' if whole else 'double'}")


def top_k(vectors: DataFrame, *, modulus: int = 20, k: int = 20, **more) -> DataFrame:
    """Operator 6: exact top-k by inner product of whole numbers; see ``grid_search``."""
    return grid_search(vectors, modulus=modulus, k=k, measure="product", **more)


def nearest(vectors: DataFrame, *, modulus: int = 50, k: int = 5, **more) -> DataFrame:
    """Operator 8: nearest neighbours by cosine; no candidate is lost, so recall is 1; see ``grid_search``."""
    return grid_search(vectors, modulus=modulus, k=k, measure="cosine", **more)


def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
