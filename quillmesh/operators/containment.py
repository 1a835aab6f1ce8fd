"""Which texts hold which others: an inverted index of the rarest part of each, and one check of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: parts of needles up to which they are broadcast
BROADCAST_ROWS = 200_000
#: letters of the parts of needles without a whole word inside
GRAM = 3
#: parts that texts of one frequent part are dealt over
PARTS = 16


def _words(text: Column) -> Column:
    return F.split(text, r"[ \t\n\r\f]+", -1)


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _pairs(words: Column) -> Column:
    """Keys of neighbouring words.  Lambdas name nothing from outside, which would be worked out for each element."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: _key("pair", a, b))


def _grams(text: Column, size: int) -> Column:
    """Keys of that many letters in a row."""
    letters = F.filter(F.split(text, "", -1), lambda x: x != "")
    n = F.greatest(F.size(letters) - (size - 1), F.lit(0))
    rows = F.slice(letters, F.lit(1), n)
    for k in range(1, size):
        rows = F.zip_with(rows, F.slice(letters, F.lit(k + 1), n), lambda a, b: F.concat(a, b))
    return F.transform(rows, lambda x: _key("gram", x))


def needle_keys(text: Column) -> Column:
    """struct(kind, keys): parts that every text holding this one has.

    A needle's first and last word may be cut out of longer words; those between are whole words of the
    text, neighbours of one another.  A needle with two of these is found by such pairs, with one by
    this word, without any by three letters in a row, or by itself if it has fewer.
    """
    words = _words(text)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    said = lambda kind, keys: F.struct(F.lit(kind).alias("kind"), F.array_distinct(keys).alias("keys"))
    short = said("gram3", _grams(text, GRAM))
    for size in range(GRAM - 1, 0, -1):
        short = F.when(F.length(text) == size, said(f"gram{size}", _grams(text, size))).otherwise(short)
    return F.when(F.size(inner) >= 2, said("pair", _pairs(inner))).when(F.size(inner) == 1, said("word", F.transform(inner, lambda w: _key("word", w)))).otherwise(short)


def text_keys(text: Column, kinds: list[str]) -> Column:
    """All parts of a text of the kinds that needles ask for, once each."""
    words = _words(text)
    keys = []
    if "pair" in kinds:
        keys.append(_pairs(words))
    if "word" in kinds:
        keys.append(F.transform(words, lambda w: _key("word", w)))
    keys += [_grams(text, size) for size in range(1, GRAM + 1) if f"gram{size}" in kinds]
    return F.array_distinct(F.concat(*keys)) if keys else F.array().cast("array<long>")


def contained(needles: DataFrame, texts: DataFrame, *, needle_id: str, needle: str, text_id: str, text: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(needle id, text id) of every needle that a text holds, letter by letter.

    Null and empty needles are in no text, null texts hold nothing; of rows that are equal in id and
    needle one counts, of texts that repeat each has its rows.  The id columns must differ in name.

    Each needle is looked up by the one of its parts that the fewest texts have.  Few needles are sent
    to where the texts are read, and no text moves; of many, parts and ids alone are shuffled, with texts of one
    frequent part dealt over tasks, and texts are fetched for what was found.
    """
    if needle_id == text_id:
        raise ValueError(f"both id columns are called {needle_id}; rename one")
    asks = needles.select(F.col(needle_id).alias("_n"), F.col(needle).cast("string").alias("_s")).filter("_s <> ''").distinct()
    asks = asks.withColumn("_k", needle_keys(F.col("_s")))
    kinds = sorted(r[0] for r in asks.select("_k.kind").distinct().collect())  # five at most
    held = texts.select(F.col(text_id).alias("_t"), F.col(text).cast("string").alias("_x")).filter("_x IS NOT NULL")
    parts = asks.select("_n", "_s", F.explode("_k.keys").alias("key"))
    wanted = parts.select("key").distinct()
    few = wanted.count() <= broadcast_rows
    found = held.select("_t", "_x", F.explode(text_keys(F.col("_x"), kinds)).alias("key"))
    seen = found.select("key").join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    # a needle with a part that no text has is nowhere
    rated = parts.join(seen, "key", "left").groupBy("_n", "_s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r"))
    rarest = rated.filter("r.n > 0").select("_n", "_s", F.col("r.key").alias("key"))
    if few and rarest.count() <= broadcast_rows:
        pairs = found.join(F.broadcast(rarest), "key").filter(F.contains("_x", "_s"))
        return pairs.select(F.col("_n").alias(needle_id), F.col("_t").alias(text_id))
    name, part = F.xxhash64("_x").alias("_h"), F.pmod(F.xxhash64("_t", "_x"), F.lit(PARTS)).cast("int").alias("part")
    dealt = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    some = found.select("key", "_t", name, part).join(dealt, ["key", "part"]).select("_n", "_s", F.col("_t").alias("_t2"), F.col("_h").alias("_h2")).distinct()
    pairs = held.withColumn("_h", F.xxhash64("_x")).join(some, F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_h") == F.col("_h2"))).filter(F.contains("_x", "_s"))
    return pairs.select(F.col("_n").alias(needle_id), F.col("_t").alias(text_id))
