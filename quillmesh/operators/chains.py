"""Chains of moves, as redirects make them: every start's end by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.settling import settled

#: rows that lead to one place beyond which it is looked up in a broadcast table; there are few such places
HUB_ROWS = 100_000


def _looked_up(open_: DataFrame, table: DataFrame, hub_rows: int) -> DataFrame:
    """``open_`` joined with what its ``at`` leads to (_to, _hops); places that many rows lead to are broadcast."""
    right = table.select(F.col("u").alias("_u"), F.col("at").alias("_to"), F.col("hops").alias("_hops"), F.col("open").alias("_open"))
    hubs = open_.groupBy("at").agg(F.count("*").alias("_n")).filter(F.col("_n") > hub_rows).select(F.col("at").alias("_u"))
    if hubs.isEmpty():
        return open_.join(right, F.col("at") == F.col("_u"))
    # at most rows / hub_rows places: a small table by construction
    crowded = right.join(F.broadcast(hubs), "_u", "left_semi")
    marked = open_.join(F.broadcast(hubs.withColumnRenamed("_u", "_hub")), F.col("at") == F.col("_hub"), "left")
    rest = marked.filter("_hub IS NULL").drop("_hub").join(right, F.col("at") == F.col("_u"))
    return rest.unionByName(marked.filter("_hub IS NOT NULL").drop("_hub").join(F.broadcast(crowded), F.col("at") == F.col("_u")))


def ends(moves: DataFrame, *, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(u, end, hops) of every place that moves: where following ``moves`` (u, to) ends, and after how many.

    A place that runs into a circle has a null end and null hops.  ``u`` is unique in ``moves``, and a move to
    nowhere (null) ends where it starts.  Each round doubles the steps that a row stands for, and rows that have
    arrived leave, so a chain of n steps takes about log2(n) rounds; rounds end when none is open.  The smallest
    power of two over the number of places bounds them: who is under way then, is in a circle.
    """
    table = moves.filter("to IS NOT NULL").select("u", F.col("to").alias("at"), F.lit(1).cast("long").alias("hops"))
    starts = table.select(F.col("u").alias("_s"))
    # a row is open while a move starts where it stands
    table = settled(table.join(starts, F.col("at") == F.col("_s"), "left").select("u", "at", "hops", F.col("_s").isNotNull().alias("open")))
    for _ in range(table.count().bit_length() + 1):
        under_way = table.filter("open")
        if under_way.isEmpty():
            break
        step = _looked_up(under_way, table, hub_rows).select("u", F.col("_to").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_open").alias("open"))
        # rows that have arrived stay to be looked up
        table = settled(table.filter("NOT open").unionByName(step))
    circles = table.filter("open").select("u", F.lit(None).cast(moves.schema["to"].dataType).alias("end"), F.lit(None).cast("long").alias("hops"))
    still = moves.filter("to IS NULL").select("u", F.col("u").alias("end"), F.lit(0).cast("long").alias("hops"))
    return table.filter("NOT open").select("u", F.col("at").alias("end"), "hops").unionByName(circles).unionByName(still)


def paths(moves: DataFrame, most: int) -> DataFrame:
    """(u, path) of every place that moves (u, to): the first ``most`` places it leads to, in order.

    Rounds double the length of the paths, log2(most) in all, and end early when no path has a
    continuation; a circle is followed until the path is full.
    """
    table = moves.select("u", F.array("to").alias("path"), F.lit(True).alias("open"))
    table = settled(table)
    size = 1
    while size < most and not table.filter("open").isEmpty():
        under_way = table.filter("open")
        last = F.element_at("path", -1)
        right = table.select(F.col("u").alias("_u"), F.col("path").alias("_more"), F.col("open").alias("_open"))
        longer = under_way.join(right, last == F.col("_u"), "left")
        longer = longer.select("u", F.slice(F.concat("path", F.coalesce("_more", F.array().cast(table.schema["path"].dataType))), 1, most).alias("path"), F.coalesce("_open", F.lit(False)).alias("open"))
        longer = longer.withColumn("open", F.col("open") & (F.size("path") < most))
        table = settled(table.filter("NOT open").unionByName(longer))
        size *= 2
    return table.select("u", "path")
