"""Walks through JSON columns of any shape in the JVM: leaves by path, and the best text of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import content_score
from quillmesh.operators.settling import settled
from quillmesh.sources.reconstruct import CONTENT_KEYS, KEY_BONUS

#: levels that one plan opens; deeper values are written in between
STEP = 8
_ADDED = ("path", "key", "kind", "value")


def nesting(json: Column) -> Column:
    """How many arrays and objects stand in each other in a JSON text; 0 of null."""
    plain = F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), '"[^"]*"', "")
    steps = F.transform(F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(steps, start, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"])
    return F.coalesce(deepest, F.lit(0))


def _step(pos: Column, key: Column) -> Column:
    plain = F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(key, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    return F.when(key.isNotNull(), F.concat(F.lit("."), plain)).otherwise(F.concat(F.lit("["), pos.cast("string"), F.lit("]")))


def json_leaves(rows: DataFrame, json_col: str, *, depth: int | None = None) -> DataFrame:
    """The other columns of ``rows`` with path, key, kind and value of every leaf of a JSON text, a row a leaf.

    Leaves are texts, numbers, booleans, nulls and empty arrays and objects; ``kind`` says which and
    ``value`` is the leaf's text (null of a null).  ``path`` is like ``$.a[0]."b c"``, ``key`` the member's
    name (null in an array and at the top).  The JSON itself is not carried, as every leaf would hold it.
    ``depth`` says how deep the values are nested at most, and is counted in a pass of its own if not
    given; what is nested deeper comes back closed, as kind array or object with its JSON, so nothing is
    lost.  Every STEP levels the open values are written to the shared folder, so a plan stays short at any
    depth.

    Null and malformed texts, those with repeated names in an object among them, have no leaves; of a text
    that goes on after its first value only that value counts.  Equal rows each have their leaves.  Columns
    called path, key, kind or value are refused with a ValueError; an empty table has no leaves.
    """
    others = [c for c in rows.columns if c.lower() != json_col.lower()]
    clash = [c for c in _ADDED if c in (x.lower() for x in others)]
    if clash:
        raise ValueError(f"columns {clash} have the names of added ones")
    spark = rows.sparkSession
    kept = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(True))
    parsed = rows.select(kept.alias("_row"), F.col(json_col).alias("_json"), F.try_parse_json(json_col).alias("_v")).filter("_v IS NOT NULL")
    if depth is None:
        depth = parsed.agg(F.max(nesting(F.col("_json")))).first()[0] or 0
    opened = parsed.select("_row", "_v", F.lit("$").alias("_path"), F.lit(None).cast("string").alias("_key"))
    for level in range(depth):
        if level and level % STEP == 0:
            opened = settled(opened)
            if opened.filter(~F.variant_get("_v", "$", "string").isin("{}", "[]") & F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")).isEmpty():
                break
        # a leaf has nothing to open and comes through as it is
        inner = opened.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
        below = F.col("pos").isNotNull()
        opened = inner.select("_row", F.coalesce("value", "_v").alias("_v"), F.when(below, F.concat("_path", _step(F.col("pos"), F.col("key")))).otherwise(F.col("_path")).alias("_path"), F.when(below, F.col("key")).otherwise(F.col("_key")).alias("_key"))
    form = F.schema_of_variant("_v")
    kind = F.when(form == "STRING", "string").when(form == "BOOLEAN", "boolean").when(form == "VOID", "null").when(form.startswith("OBJECT"), "object").when(form.startswith("ARRAY"), "array").otherwise("number")
    return opened.select(*(["_row.*"] if others else []), F.col("_path").alias("path"), F.col("_key").alias("key"), kind.alias("kind"), F.variant_get("_v", "$", "string").alias("value"))


def scored_texts(leaves: DataFrame) -> DataFrame:
    """The text leaves with form and score: html, markdown or plain content, more under a well-known key.

    Texts that aren't content have score 0, under any key.
    """
    scored = leaves.filter("kind = 'string'").withColumn("_s", content_score(F.col("value")))
    bonus = F.when((F.col("_s.score") > 0) & F.coalesce(F.col("key").isin(*CONTENT_KEYS), F.lit(False)), KEY_BONUS).otherwise(0)
    return scored.select(*leaves.columns, F.col("_s.kind").alias("form"), (F.col("_s.score") + bonus).cast("long").alias("score")).drop("kind")


def best_texts(scored: DataFrame, by: str) -> DataFrame:
    """(by, path, form, score, value) of the best text of each ``by``: the highest score, of equals the smallest path.

    Rows of one ``by``, null too, count together; those whose texts all score 0 have none.  The winner of each task is kept before the shuffle.
    """
    # no filter on the score: pushed below the scoring, it would score each text twice more
    best = F.min_by(F.struct("path", "form", "score", "value"), F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"))))
    return scored.groupBy(by).agg(best.alias("_b")).filter("_b IS NOT NULL").select(by, "_b.*")
