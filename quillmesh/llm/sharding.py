"""Operator 9, sharding by extendible hashing: a directory of hash prefixes, split where it overflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import documents, settled

BITS = 60
LIMIT = 1 << 20
#: bits by which one pass over overfull prefixes looks deeper, and spare bits of the first pass
DEEPER = 10
SPARE = 5
#: bits that one step of a pass decides, so that at most 2 ** STEP sums meet under one prefix
STEP = 8


def _hash60(key):
    """The first 60 bits of the id's MD5, which any engine can compute."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _prefix(h, depth: int):
    return F.shiftrightunsigned(h, BITS - depth)


def _fitting(rows: DataFrame, at: int, first: int, limit: int) -> DataFrame:
    """(p, depth, prefix, bytes, rows): the shallowest bucket from depth ``first`` on that fits, of each prefix p of ``at`` bits that has one.

    ``rows`` holds p, b and n, the sums of whole prefixes: for each, also those of all its neighbours
    under the prefixes of depth ``first``.
    """
    spread = rows.select("p", "b", "n", F.explode(F.sequence(F.lit(first), F.lit(at))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(p, {at} - depth)"))
    sums = spread.groupBy("depth", "prefix").agg(F.sum("b").alias("bytes"), F.sum("n").alias("rows"))
    leaf = sums.filter((F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS))
    own = spread.select("p", "depth", "prefix").join(leaf, ["depth", "prefix"])
    best = own.groupBy("p").agg(F.min(F.struct("depth", "prefix", "bytes", "rows")).alias("x"))
    return best.select("p", "x.depth", "x.prefix", "x.bytes", "x.rows")


def directory(slim: DataFrame, limit: int) -> DataFrame:
    """Entries (fine, at, depth, prefix, bytes, rows): prefixes of ``at`` bits and the bucket that each points to.

    ``slim`` has _hash and _bytes.  A bucket splits on its next bit while it holds more than ``limit``
    bytes and more than one row.  The first pass sums prefixes of a depth that the total implies, and
    the sums are folded in steps of a few bits up to the root; from there down, a step decides what fits
    within its bits and leaves the rest to the next.  Only prefixes that still overflow are looked at
    again, deeper.  An empty table has an empty directory.
    """
    total = slim.agg(F.sum("_bytes").alias("b")).first()["b"] or 0
    at = min(BITS, max(1, (int(total) // limit).bit_length()) + SPARE)
    upper, rest, found = 0, slim, None
    while True:
        fine = settled(rest.groupBy(_prefix(F.col("_hash"), at).alias("p")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")))
        marks = [*range(upper + STEP, at, STEP), at]
        folded = {at: fine}
        for low, high in zip(reversed(marks[:-1]), reversed(marks[1:])):
            folded[low] = settled(folded[high].groupBy(F.expr(f"shiftright(p, {high - low})").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")))
        over, first = None, upper
        for k, mark in enumerate(marks):
            rows = folded[mark]
            if over is not None:
                rows = rows.join(over.withColumnRenamed("p", "_o"), F.expr(f"shiftright(p, {mark - marks[k - 1]})") == F.col("_o"), "left_semi")
            known = settled(_fitting(rows, mark, first, limit))
            over, first = settled(rows.select("p").join(known.select("p"), "p", "left_anti")), mark + 1
            told = fine.select(F.col("p").alias("fine")).join(known, F.expr(f"shiftright(fine, {at - mark})") == F.col("p")).select("fine", F.lit(at).alias("at"), "depth", "prefix", "bytes", "rows")
            found = told if found is None else found.unionByName(told)
        if at == BITS or over.isEmpty():
            return settled(found)
        rest = rest.join(over.withColumnRenamed("p", "_o"), _prefix(F.col("_hash"), at) == F.col("_o"), "left_semi")
        upper, at = at + 1, min(BITS, at + DEEPER)


def _placed(docs: DataFrame, keep: list[str], limit: int, id_col: str, text_col: str) -> DataFrame:
    """The kept columns (as c0_, c1_ ...) of every row, with _size, _depth, _prefix and _part of its shard."""
    key = F.when(F.col(id_col).isNull(), F.lit("")).otherwise(F.col(id_col).cast("string"))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(keep)], F.col(id_col).alias("_id"), size.alias("_size"), _hash60(key).alias("_hash"))
    leaves = directory(rows.select("_hash", F.col("_size").alias("_bytes")), limit)
    levels = sorted(r["at"] for r in leaves.select("at").distinct().collect())
    if not levels:
        return rows.select(*[f"c{i}_" for i in range(len(keep))], "_size", F.lit(0).alias("_depth"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_part"))
    out, rest = None, rows
    for k, at in enumerate(levels):
        entries = leaves.filter(F.col("at") == at).select(F.col("fine").alias("_fine"), F.col("depth").cast("int").alias("_depth"), F.col("prefix").alias("_prefix"), F.col("bytes").alias("_total"), F.col("rows").alias("_rows"))
        here = rest.join(entries, _prefix(F.col("_hash"), at) == F.col("_fine")).drop("_fine")
        out = here if out is None else out.unionByName(here)
        if k + 1 < len(levels):
            rest = rest.join(entries.select("_fine"), _prefix(F.col("_hash"), at) == F.col("_fine"), "left_anti")
    crowded = (F.col("_total") > limit) & (F.col("_rows") > 1)
    plain = out.filter(~crowded).withColumn("_part", F.lit(0).cast("long"))
    big = F.col("_size") > limit // 2
    alike = Window.partitionBy("_depth", "_prefix", big).orderBy("_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(alike), F.lit(0))
    at_row = F.coalesce(F.count("*").over(alike), F.lit(0))
    parted = out.filter(crowded).withColumn("_part", F.when(big, -1 - at_row).otherwise(F.floor(before / (limit // 2))).cast("long"))
    return plain.unionByName(parted).drop("_id", "_hash", "_total", "_rows")


def assign_shards(docs: DataFrame, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, bytes, and its shard as depth, prefix and part.

    A shard is the bucket of the ids whose 60-bit hash begins with ``prefix`` (of ``depth`` bits), the
    shallowest that holds at most ``limit`` bytes of text or a single row.  Rows whose hashes are equal
    to the last bit (repeated ids) and together exceed the limit are parted by running bytes: rows of
    over half the limit alone, others in stretches of half the limit; ``part`` is 0 elsewhere.  So only
    a row that is over the limit by itself makes a shard that is.  Null texts have no bytes, a null id
    hashes as the empty string; other columns, whatever their names, are not carried; an empty table
    gives an empty result.
    """
    rows = _placed(docs, [id_col], limit, id_col, text_col)
    return rows.select(F.col("c0_").alias(id_col), F.col("_size").alias("bytes"), F.col("_depth").alias("depth"), F.col("_prefix").alias("prefix"), F.col("_part").alias("part"))


def write_shards(docs: DataFrame, path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> None:
    """Writes every row with all its columns as Parquet, one folder (``shard_col``=depth-prefix-part) for each shard.

    Each row goes to the shard that ``assign_shards`` gives it, repeated ids and rows included, null ids
    and texts like others.  A table that has a column ``shard_col`` is refused with a ValueError; an
    empty table makes an empty folder.
    """
    if shard_col in docs.columns:
        raise ValueError(f"the table already has a column {shard_col}; name another by shard_col")
    name = F.concat_ws("-", F.lpad(F.col("_depth").cast("string"), 2, "0"), F.lower(F.hex("_prefix")), F.col("_part").cast("string"))
    rows = _placed(docs, docs.columns, limit, id_col, text_col)
    named = rows.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)], name.alias(shard_col))
    named.repartition(shard_col).write.mode("overwrite").partitionBy(shard_col).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE s AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
r AS (SELECT doc_id, bytes, h, 0 AS depth, CAST(0 AS BIGINT) AS prefix, sum(bytes) OVER () AS total, count(*) OVER () AS n FROM s
      UNION ALL
      SELECT doc_id, bytes, h, depth + 1, h >> ({BITS} - depth - 1), sum(bytes) OVER (PARTITION BY h >> ({BITS} - depth - 1)),
             count(*) OVER (PARTITION BY h >> ({BITS} - depth - 1))
      FROM r WHERE total > {LIMIT} AND n > 1 AND depth < {BITS})
SELECT doc_id, bytes, depth, prefix, CAST(0 AS BIGINT) AS part FROM r WHERE total <= {LIMIT} OR n = 1
"""
