"""Sketches against exact figures, within their stated errors, made at once and merged."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmesh.operators.sketches import ITEMS, estimates, rolled_up, sketched


def test_large_groups_within_their_errors(spark):
    """Two thirds of the rows in one group, half of its values one."""
    n = 300_000
    rows = spark.range(n).select((F.col("id") % 3 == 0).alias("a"), (F.col("id") % 5).alias("b"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 90_001)).alias("v"), (F.col("id") * 7919 % n).alias("x"))
    merged = estimates(rolled_up(sketched(rows, ["a", "b"], "v", "x"), ["a", "b"]), quantiles=(0.1, 0.5, 0.9)).collect()
    assert len(merged) == 10 + 2 + 1
    for r in merged:
        own = rows.filter((F.lit(r["level"] > 1) | F.col("a").eqNullSafe(F.lit(r["a"]))) & (F.lit(r["level"] > 0) | F.col("b").eqNullSafe(F.lit(r["b"]))))
        exact = own.agg(F.count("*"), F.countDistinct("v"), F.count_if(F.col("v") == "hot")).first()
        assert r["n"] == exact[0]
        assert abs(r["n_distinct"] - exact[1]) <= 4 * 0.0082 * exact[1]
        assert r["heavy"][0]["item"] == "hot" and abs(r["heavy"][0]["count"] - exact[2]) <= 3.5 / ITEMS * exact[0]
        for q, x in zip((0.1, 0.5, 0.9), r["quantiles"]):
            assert abs(own.filter(F.col("x") <= x).count() / exact[0] - q) <= 0.012


def test_nulls_ties_and_empty_tables(spark):
    schema = "g string, v string, x int"
    rows = spark.createDataFrame([(None, "a", 1), (None, "a", 1), (None, None, None), ("g", None, None), ("h", "", 5), ("h", "b", 5)], schema)
    got = {r["g"]: (r["n"], r["n_distinct"], Counter({h["item"]: h["count"] for h in r["heavy"]}), r["quantiles"]) for r in estimates(sketched(rows, ["g"], "v", "x")).collect()}
    assert got[None] == (3, 1, Counter(a=2), [1])
    assert got["g"] == (1, 0, Counter(), None)
    assert got["h"][0] == 2 and got["h"][2]["b"] == 1 and got["h"][3] == [5]
    assert sketched(rows.limit(0), ["g"], "v", "x").count() == 0
    with pytest.raises(ValueError):
        sketched(rows.withColumnRenamed("g", "N"), ["N"], "v", "x")
