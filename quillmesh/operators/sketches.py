"""Mergeable sketches of groups: distinct values, heavy values and quantiles, once made and then only merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: registers of a distinct sketch as a power of two: a relative standard error of 1.04 / 2**7, some 0.8 %
LOG_K = 14
#: counters of a heavy-value sketch: counts are at most 3.5 / ITEMS of a group's rows too high or low
ITEMS = 1024
#: of a quantile sketch: ranks are off by some 0.7 % of a group's values at most, at 99 % confidence
KLL_K = 400
_HELD = ("n", "distinct_sketch", "heavy_sketch", "number_sketch")


def sketched(rows: DataFrame, by: list[str], value: str, number: str) -> DataFrame:
    """(by, n, distinct_sketch, heavy_sketch, number_sketch): the rows of each group, ``value``'s and ``number``'s sketches.

    Each task sketches what it reads, so a group that holds most rows moves one sketch a task.  ``value`` is
    sketched as a string, ``number`` as a long; nulls of either are counted in n alone.  Null groups are
    groups; an empty table has none.  Group columns named as added ones are refused with a ValueError.
    """
    clash = [c for c in by if c.lower() in _HELD]
    if clash:
        raise ValueError(f"columns {clash} have the names of added ones")
    slim = rows.select(*by, F.col(value).cast("string").alias("_value"), F.col(number).cast("long").alias("_number"))
    heavy = F.expr(f"approx_top_k_accumulate(_value, {ITEMS}) FILTER (WHERE _value IS NOT NULL)")
    return slim.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg("_value", LOG_K).alias("distinct_sketch"), heavy.alias("heavy_sketch"), F.kll_sketch_agg_bigint("_number", KLL_K).alias("number_sketch"))


def rolled_up(sketches: DataFrame, levels: list[str]) -> DataFrame:
    """The sketches of every prefix of ``levels`` down to the whole, merged; ``level`` is how many columns are folded.

    The rows that were sketched aren't read again.  A level's columns that are folded are null.
    """
    merged = [F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr(f"approx_top_k_combine(heavy_sketch, {ITEMS})").alias("heavy_sketch"), F.kll_merge_agg_bigint("number_sketch").alias("number_sketch")]
    folded = F.bit_count(F.grouping_id()).cast("int").alias("level")
    return sketches.rollup(*levels).agg(folded, *merged)


def estimates(sketches: DataFrame, *, top: int = 10, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Sketches replaced by n_distinct, heavy (an array of item and count, heaviest first) and quantiles (an array, null without numbers)."""
    points = F.array(*[F.kll_sketch_get_quantile_bigint("number_sketch", F.lit(q)) for q in quantiles])
    own = [c for c in sketches.columns if c not in _HELD[1:]]
    return sketches.select(*own, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), F.expr(f"approx_top_k_estimate(heavy_sketch, {top})").alias("heavy"), F.when(F.kll_sketch_get_n_bigint("number_sketch") > 0, points).alias("quantiles"))
