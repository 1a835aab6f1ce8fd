"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import settled

#: edges of one part of an edge table, and edges up to which each node's least neighbour is broadcast
PART, BROADCAST_ROWS = 50_000, 200_000


def _rehung(edges: DataFrame, n: int, *, large: bool) -> DataFrame:
    """Every node's neighbours hung onto its smallest neighbour (or itself).

    ``edges`` holds (a, b) with a > b.  A large star moves the larger neighbours of each node; a small
    star the smaller ones, and the node itself.  ``n`` is about how many edges there are: few of them take few
    parts and no shuffle but one.
    """
    small = F.broadcast if n <= BROADCAST_ROWS else lambda x: x
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(small(low), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(small(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct().coalesce(max(1, -(-n // PART)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    ``edges`` has two columns of one ordered type; loops and repeated edges do no harm, edges with a null end
    are passed over, and an empty table gives an empty result.  Each round is
    written to the checkpoint folder; two numbers a round reach the driver.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    pairs = settled(pairs)
    mark = _mark(pairs)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        pairs = settled(_rehung(_rehung(pairs, mark[0], large=True), mark[0], large=False))
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    out = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())


def _mark(pairs: DataFrame) -> tuple:
    r = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
