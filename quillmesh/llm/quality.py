"""Operator 10, quality classifier: document evidence under a hierarchical empirical Bayes prior.

Two small logistic models, trained here on labelled rows, give each document's chance to be junk or
toxic.  Sites are two levels, host and path under it; documents carry no URL, so by default the
columns source and lang stand for them.  Grouped sums of the evidence give each host a
posterior that is shrunk toward the corpus, and each path one that is shrunk toward its host, by
precisions that the spread of the group means itself implies; a document's odds are then moved by
its path's odds, with its own share of them taken out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.llm.common import U64, documents, hash_spans, lean, refuse_clash, settled, slices, text_buffer, word_spans, written

CHUNK_BYTES = 1 << 20
#: labelled rows that the models are trained on, the first by a hash of the id
MAX_LABELS = 20_000
#: word and stem buckets of the toxic lexicon, and the most of them that it keeps
BUCKET_BITS = 20
#: bytes of a word that make its stem
STEM = 4
#: parts of the labelled rows, each judged by the lexicon of the others
FOLDS = 4
MAX_LEXICON = 4096
#: site rows up to which the site table is broadcast; beyond, it is joined by shuffle
BROADCAST_SITES = 200_000
THRESHOLD = 0.4
STYLE = 16

_LETTER = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 other sign
_LETTER[97:123] = 1
_LETTER[65:91] = 2
_LETTER[48:58] = 3
for _c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _LETTER[_c] = 4
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]"]] = True


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def style_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: style figures; and the row and bucket of each distinct (row, word) and (row, stem), case and outer marks aside."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    raw = hash_spans(data, starts, ends)
    kind = _LETTER[data]
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets).astype(np.float64), 1)

    def bytes_like(mask):
        return np.bincount(row_of[mask], minlength=n) / size

    length = ends - starts
    same = np.zeros(len(raw), bool)
    same[1:] = (raw[1:] == raw[:-1]) & (rows[1:] == rows[:-1])
    pair = np.zeros(len(raw), bool)
    pair[2:] = (raw[2:] == raw[:-2]) & (rows[2:] == rows[:-2])
    key = raw ^ (rows.astype(U64) * U64(0x9E3779B97F4A7C15))
    distinct = np.unique(key, return_index=True)[1]
    kinds = _per_row(np.ones(len(distinct)), rows[distinct], n)
    loud = kind[starts] == 2 if len(starts) else np.zeros(0, bool)
    shout = loud & (length > 1) & (kind[np.minimum(starts + 1, max(len(data) - 1, 0))] == 2) if len(starts) else loud
    last = kind[ends - 1] == 4 if len(ends) else np.zeros(0, bool)
    alone = (length == 1) & last
    double = last & (length > 2) & (kind[np.maximum(ends - 2, 0)] == 4) if len(ends) else last
    figures = [
        np.log1p(words), 1 - kinds / some, _per_row(same, rows, n) / some, _per_row(pair, rows, n) / some,
        bytes_like(kind == 2), bytes_like(kind == 3), bytes_like(kind == 4), bytes_like(data == 10),
        _per_row(shout, rows, n) / some, _per_row(last, rows, n) / some, _per_row(alone, rows, n) / some, _per_row(double, rows, n) / some,
        _per_row(length, rows, n) / some / 8, _per_row(length <= 3, rows, n) / some, _per_row(length >= 8, rows, n) / some,
        (1 - kinds / some) * np.minimum(np.log1p(words), 8) / 8,
    ]
    low, high = starts.copy(), ends.copy()
    for _ in range(3):
        cut = (high > low) & _TRIM[data[np.maximum(high - 1, 0)]] if len(high) else np.zeros(0, bool)
        high = high - cut
        cut = (high > low) & _TRIM[data[np.minimum(low, max(len(data) - 1, 0))]] if len(low) else cut
        low = low + cut
    folded = _FOLD[data]
    bucket = (hash_spans(folded, low, high) >> U64(64 - BUCKET_BITS)).astype(np.int64)
    long = np.flatnonzero(high - low > STEM)
    stem = (~hash_spans(folded, low[long], low[long] + STEM) >> U64(64 - BUCKET_BITS)).astype(np.int64)
    both = np.unique(np.concatenate([rows, rows[long]]).astype(np.int64) << BUCKET_BITS | np.concatenate([bucket, stem]))
    return np.stack(figures, axis=1), both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the first is the constant), means and scales, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


@dataclass
class Model:
    junk: tuple
    toxic: tuple
    lexicon: np.ndarray  # sorted buckets
    weight: np.ndarray  # log odds of each

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row to be junk, and to be toxic; 0.5 of junk for a row without words."""
        style, rows, buckets = style_of(data, offsets)
        out = [_chance(self.junk, _curved(style)), _chance(self.toxic, lexicon_figures(rows, buckets, style, self.lexicon, self.weight))]
        blank = style[:, 0] == 0
        out[0][blank] = 0.5
        out[1][blank] = 0.0
        return out[0], out[1]


def _curved(style: np.ndarray) -> np.ndarray:
    """Shares and their roots, so that small shares can weigh."""
    return np.concatenate([style, np.sqrt(np.maximum(style[:, 1:], 0))], axis=1)


def _chance(model: tuple, x: np.ndarray) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))


def lexicon_figures(rows, buckets, style, lexicon, weight) -> np.ndarray:
    n = len(style)
    if not len(lexicon):
        return np.zeros((n, 3))
    at = np.minimum(np.searchsorted(lexicon, buckets), len(lexicon) - 1)
    hit = lexicon[at] == buckets
    found, gain = rows[hit], weight[at[hit]]
    count = np.bincount(found, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, found, gain)
    return np.stack([np.minimum(count, 4), top, np.minimum(np.bincount(found, weights=gain, minlength=n), 20)], axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, quality, toxic) of at most ``limit`` labelled ids, one row each.

    Of an id's labels the lowest quality and the highest toxic count, of its rows the text that is first in
    order, so no order of rows decides.  The sample of labels is bounded, so it is broadcast; texts that
    repeat an id are reduced where they are read.
    """
    own = labels.filter(f"{id_col} IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    own = own.groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(limit)
    texts = docs.join(F.broadcast(own.select(id_col)), id_col, "left_semi").groupBy(id_col).agg(F.min(text_col).alias(text_col))
    return texts.join(F.broadcast(own), id_col)


def gathered(slim: DataFrame, lexica: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of labelled rows (quality, toxic, style, words, fold): style, figures under the lexicon of the other folds, quality and toxic.

    Words, which are most of a row, stay in the tasks: a row takes some 160 bytes of the driver.
    """

    def told(batches):
        for batch in batches:
            style = np.stack([np.frombuffer(b, np.float64) for b in batch.column(2).to_pylist()]) if batch.num_rows else np.zeros((0, STYLE))
            bags, folds = batch.column(3).to_pylist(), batch.column(4).to_numpy()
            figures = np.zeros((batch.num_rows, 3))
            for k, (lexicon, weight) in enumerate(lexica):
                own = np.flatnonzero(folds == k)
                if len(own):
                    words = [np.frombuffer(bags[i], np.int32) for i in own]
                    at = np.repeat(np.arange(len(own)), [len(b) for b in words])
                    figures[own] = lexicon_figures(at, np.concatenate(words).astype(np.int64), style[own], lexicon, weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in (style, figures)]], names=["quality", "toxic", "style", "figures"])

    rows = slim.mapInArrow(lean(told), "quality int, toxic int, style binary, figures binary").toArrow()
    style, figures = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float64).reshape(-1, n) for c, n in (("style", STYLE), ("figures", 3)))
    return style, figures, rows.column("quality").to_numpy(), rows.column("toxic").to_numpy()


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELS) -> Model:
    """Fits both models on at most ``limit`` labelled rows; what reaches the driver is bounded by that.

    All rows give the lexicon.  Its weight as evidence comes from each fold's figures under the lexicon
    of the other folds, so a word that a few rows hold by chance isn't trusted for those rows' sake.
    """
    sample = settled(labelled_sample(docs.select(id_col, F.col(text_col).cast("string").alias("_t")), labels, limit, id_col, "_t").select(id_col, "_t", "quality", "toxic"))

    def gather(batches):
        for whole in batches:
            _, sizes = text_buffer(whole.column(1))
            for i, j in slices(sizes, CHUNK_BYTES):
                part = whole.slice(i, j - i)
                data, offsets = text_buffer(part.column(1))
                style, rows, buckets = style_of(data, offsets)
                bounds = np.searchsorted(rows, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2).cast(pa.int32()), part.column(3).cast(pa.int32()), pa.array([r.tobytes() for r in style], pa.binary()), pa.array([buckets[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                    names=["i", "quality", "toxic", "style", "words"],
                )

    slim = settled(sample.mapInArrow(lean(gather), "i long, quality int, toxic int, style binary, words binary"))
    fold = F.pmod(F.xxhash64("i", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")

    def bags(batches):
        for batch in batches:
            kinds = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for fold_, want in sorted({x for x in kinds if x[1] in (0, 1)}):
                own = [np.frombuffer(b, np.int32) for b, x in zip(batch.column(2).to_pylist(), kinds) if x == (fold_, want)]
                words, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), *[pa.array(np.full(len(words), x, np.int32)) for x in (fold_, want)], pa.array(n.astype(np.int64))], names=["word", "fold", "toxic", "n"])

    counts = slim.select(fold, "toxic", "words").mapInArrow(lean(bags), "word int, fold int, toxic int, n long")

    def tally(toxic: int, without: int):
        return F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") != without), F.col("n")).otherwise(0))

    parts = [-1, *range(FOLDS)]  # all rows, and all but a fold
    counts = settled(counts.groupBy("word").agg(*[tally(t, k).alias(f"{name}{k + 1}") for k in parts for t, name in ((1, "bad"), (0, "good"))]).filter("bad0 >= 3"))
    totals = {(r["fold"], r["toxic"]): r["n"] for r in slim.groupBy(fold, "toxic").agg(F.count("*").alias("n")).collect()}

    def lexicon_of(k: int) -> tuple[np.ndarray, np.ndarray]:
        bad_docs, good_docs = (sum(n for (f, t), n in totals.items() if t == want and f != k) for want in (1, 0))
        bad, good = F.col(f"bad{k + 1}"), F.col(f"good{k + 1}")
        rate = F.log((bad + 0.5) / (bad_docs + 1)) - F.log((good + 0.5) / (good_docs + 1))
        words = counts.filter(bad >= 3).select("word", rate.alias("gain")).filter("gain > 1.5").orderBy(F.desc("gain"), "word").limit(MAX_LEXICON).collect()
        words = sorted((r["word"], r["gain"]) for r in words)
        return np.array([w for w, _ in words], np.int64), np.array([g for _, g in words])

    (lexicon, weight), *others = [lexicon_of(k) for k in parts]
    style, figures, quality, bad = gathered(slim.select("quality", "toxic", "style", "words", fold), others)
    if not len(style):
        blank = (np.zeros(1 + 2 * STYLE - 1), np.zeros(2 * STYLE - 1), np.ones(2 * STYLE - 1))
        return Model(blank, (np.array([-10.0, 0, 0, 0]), np.zeros(3), np.ones(3)), lexicon, weight)
    junk = fit_logistic(_curved(style), (quality == 0).astype(float))
    if not len(lexicon):
        return Model(junk, (np.array([-10.0, 0, 0, 0]), np.zeros(3), np.ones(3)), lexicon, weight)
    toxic = fit_logistic(figures, bad.astype(float))
    return Model(junk, toxic, lexicon, weight)


def evidence(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Adds _junk and _toxic, the models' chances, to every row; all columns are carried, and clashing names refused."""
    refuse_clash(docs.columns, ["_junk", "_toxic"])
    at = docs.schema.fieldNames().index(text_col)
    schema = StructType([*docs.schema.fields]).add("_junk", "double").add("_toxic", "double")

    def run(batches):
        for whole in batches:
            _, sizes = text_buffer(whole.column(at))
            for i, j in slices(sizes, CHUNK_BYTES):
                batch = whole.slice(i, j - i)
                junk, toxic = model.chances(*text_buffer(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(junk), pa.array(toxic)], names=[*batch.schema.names, "_junk", "_toxic"])

    return docs.mapInArrow(lean(run), schema)


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_priors(found: DataFrame) -> DataFrame:
    """Per host and path: sums of evidence, and the shrunken host posterior and precisions.

    ``found`` has host, path and p, the chance to be clean.  A precision is m (1 - m) / v - 1, with v
    what the spread of group means exceeds that which their sizes explain, held to [10, 1e6].
    """
    paths = settled(found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    one = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hq").alias("q"), F.count("*").alias("g"), F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn"), 2)).alias("b")).first()
    n, s, q, g, b = (float(one[x] or 0) for x in "nsqgb")
    mean = s / n if n else 0.5

    def precision(groups: float, between: float, centre: float) -> float:
        inside = (q - between) / max(n - groups, 1)
        spread = ((between - centre) / max(groups - 1, 1) - inside) / max(n / max(groups, 1), 1)
        return float(np.clip(mean * (1 - mean) / spread - 1, 10, 1e6)) if spread > 1e-12 else 1e6

    k_host = precision(g, b, n * mean * mean)
    two = paths.agg(F.count("*").alias("g"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n"), 2)).alias("b")).first()
    k_path = precision(float(two["g"] or 0), float(two["b"] or 0), b)
    out = paths.join(hosts.select(F.col("host").alias("_h"), "hn", "hs"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h", "q")
    return settled(out.withColumns({"mean": F.lit(mean), "k_host": F.lit(k_host), "k_path": F.lit(k_path)}))


def posterior(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds ``quality``: each row's chance to be clean under its site's prior, its own part left out."""
    right = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    if sites.count() <= BROADCAST_SITES:
        right = F.broadcast(right)
    joined = found.join(right, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    p = F.col("p")
    host = (F.col("k_host") * F.col("mean") + F.col("hs") - p) / (F.col("k_host") + F.col("hn") - 1)
    path = (F.col("k_path") * host + F.col("s") - p) / (F.col("k_path") + F.col("n") - 1)
    moved = _logit(p) - _logit(F.col("mean")) + _logit(path)
    return joined.withColumns({"site_prior": path, "quality": 1 / (1 + F.exp(-moved))}).drop("_host", "_path", "n", "s", "hn", "hs", "mean", "k_host", "k_path")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, limit: int = MAX_LABELS, carry: list[str] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` (or the columns to ``carry``), with _junk, _toxic, _site_prior, _quality and _keep.

    ``labels`` holds the id, quality (1 good, 0 junk) and toxic (1 toxic); rows with a null among them
    don't count, and of an id's labels the lowest quality and the highest toxic do.  Without any labelled row every document has even odds
    and is kept.  A null, empty or blank text has even odds of junk.  Null hosts and paths are sites
    like others.  Repeated rows each count as a document and get the same figures.  A row is kept if
    its quality is at least ``threshold``.  An empty table gives an empty result.  A table with columns
    called like the added ones is refused with a ValueError.
    """
    refuse_clash(docs.columns, ["_junk", "_toxic", "_site_prior", "_quality", "_keep"])
    model = train(docs, labels, id_col=id_col, text_col=text_col, limit=limit)
    clean = (1 - F.col("_junk")) * (1 - F.col("_toxic"))
    columns = docs.columns if carry is None else carry
    own = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(columns)], F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    # texts are scored once; what they give is read for the sites' sums and again for the rows
    scored = written(evidence(own, model).withColumn("p", clean).drop("text"), "quality")
    judged = posterior(scored, site_priors(scored.select("host", "path", "p")))
    return judged.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(columns)], "_junk", "_toxic", F.col("site_prior").alias("_site_prior"), F.col("quality").alias("_quality"), (F.col("quality") >= threshold).alias("_keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=["doc_id", "source", "lang"])
    return out.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), F.col("_junk").alias("junk"), F.col("_toxic").alias("toxic"), F.col("_site_prior").alias("site_prior"), F.col("_quality").alias("quality"), F.col("_keep").cast("int").alias("keep"))
