"""Snapshots of pages and the changes between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.hashing import block_key, content_hash
from quillmesh.operators.classify import block_text

SNAPSHOT_DAYS = 30
#: times as ISO 8601 writes them, in the session's zone
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
KINDS = ("added", "removed", "changed", "unchanged")


def block_content() -> Column:
    """What is compared of a block: its text, its code, or all of it as JSON."""
    names = [c for c in ("type", "src", "alt", "ordered", "items", "headers", "rows", "html_id", "html_class", "classification", "confidence", "marker")]
    return F.coalesce(F.col("text"), F.col("code"), F.to_json(F.struct(*names)))


def keyed(blocks: DataFrame) -> DataFrame:
    """Blocks with key and content; needs classification, confidence and marker columns (null if not set)."""
    missing = {c: F.lit(None).cast(t) for c, t in (("classification", "string"), ("confidence", "double"), ("marker", "string")) if c not in blocks.columns}
    blocks = blocks.withColumns(missing)
    return blocks.withColumns({"key": block_key(F.coalesce("classification", "type"), block_text()), "content": block_content()})


def changes(previous: DataFrame, current: DataFrame, group: str = "url") -> DataFrame:
    """(group, change_ord, change, classification, before, after) for added, changed, unchanged and removed keys.

    Both sides hold group, key, ord, content and classification.  Rows of the current side come in its
    order, then what was removed in the order of the previous one.  An edited text has another key, so
    it is one removal and one addition; only blocks keyed by less than their content can be changed.
    """
    # both sides are dealt out once, by group: the keys of a group stand together, and so do its changes
    names = (group, "key", "ord", "content", "classification")
    rows = previous.select(*names, F.lit(False).alias("_now")).unionByName(current.select(*names, F.lit(True).alias("_now"))).repartition(group)
    alone = F.when(F.col(group).isNull(), F.col("_now")).alias("_alone")  # no group is like another

    def side(now: bool, mark: str) -> list[Column]:
        """Of repeated keys the last content, at the first place."""
        place = F.when(F.col("_now") == now, F.col("ord"))
        return [F.min(place).alias(f"{mark}_ord"), F.max_by(F.struct("content", "classification"), place).alias(mark), F.max(F.when(F.col("_now") == now, True)).alias("has" if now else "had")]

    both = rows.groupBy(group, "key", alone).agg(*side(False, "p"), *side(True, "c"))
    both = both.select(group, "key", "had", "has", F.col("p.content").alias("before"), F.col("c.content").alias("after"), "p_ord", "c_ord", F.coalesce("c.classification", "p.classification").alias("classification"))
    kind = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    out = both.select(group, "key", kind.alias("change"), "classification", "before", "after", "c_ord", "p_ord")
    order = Window.partitionBy(group).orderBy(F.col("c_ord").isNull(), "c_ord", "p_ord")
    return out.withColumn("change_ord", F.row_number().over(order) - 1).drop("c_ord", "p_ord")


def summary(changed: DataFrame, group: str = "url") -> DataFrame:
    counts = [F.count_if(F.col("change") == k).alias(k) for k in KINDS]
    return changed.groupBy(group).agg(*counts)


def unified(changed: DataFrame, group: str = "url", previous_at: DataFrame | None = None, current_at: Column | None = None) -> DataFrame:
    """(group, body): the changes as text, one hunk a change.

    ``previous_at`` (group, fetched_at) tells when the earlier side was fetched, ``current_at`` when the
    later one was.
    """
    line = lambda mark, c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, "\n", -1), lambda x: F.concat(F.lit(mark), x)))
    none = F.array().cast("array<string>")
    gone = F.when(F.col("change").isin("removed", "changed"), line("-", F.coalesce("before", F.lit("")))).otherwise(none)
    come = F.when(F.col("change").isin("added", "changed"), line("+", F.coalesce("after", F.lit("")))).otherwise(none)
    label = F.coalesce("classification", "change")
    hunk = F.concat(F.array(F.concat(F.lit("@@ "), label, F.lit(" @@"))), gone, come, F.array(F.lit("")))
    shown = F.when(F.col("change") != "unchanged", F.struct("change_ord", hunk.alias("lines")))
    rows = changed.groupBy(group).agg(F.array_sort(F.collect_list(shown)).alias("h"), *[F.count_if(F.col("change") == k).alias(k) for k in KINDS])
    before = F.lit(None).cast("string")
    if previous_at is not None:
        rows = rows.join(previous_at.select(group, F.date_format("fetched_at", _TIME).alias("_at")), group, "left")
        before = F.col("_at")
    after = F.lit("") if current_at is None else F.date_format(current_at, _TIME)
    escaped = F.replace(F.replace(F.col(group), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    head = F.array(
        F.concat(F.lit("diff --quill "), escaped), F.concat(F.lit("--- "), F.coalesce(before, F.lit("/dev/null"))), F.concat(F.lit("+++ "), after),
        F.concat(F.lit("@@ +"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"), F.lit(" ~"), F.col("changed").cast("string"), F.lit(" ("), F.col("unchanged").cast("string"), F.lit(" unchanged) @@")), F.lit(""),
    )
    body = F.when(F.size("h") == 0, F.array(F.lit(" (no changes)"))).otherwise(F.flatten(F.transform("h", lambda x: x["lines"])))
    return rows.select(group, F.concat(F.rtrim(F.regexp_replace(F.array_join(F.concat(head, body), "\n"), r"\s+$", "")), F.lit("\n")).alias("body"))


def snapshots(blocks: DataFrame, fetched_at: Column) -> DataFrame:
    """(url, fetched_at, content_hash, n_blocks, blocks): a page's flattened blocks, and one hash of all they say."""
    rows = (blocks if "key" in blocks.columns else keyed(blocks)).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "content", "classification"))).alias("blocks"), F.count("*").alias("n_blocks"))
    return rows.select("url", fetched_at.alias("fetched_at"), content_hash(F.array_join(F.transform("blocks", lambda x: x["content"]), "\n")).alias("content_hash"), "n_blocks", "blocks")


def stored_blocks(table: DataFrame) -> DataFrame:
    """(url, ord, key, content, classification): the blocks of snapshots as rows, to be one side of ``changes``."""
    return table.select("url", F.explode("blocks").alias("b")).select("url", "b.*")


def upsert_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest snapshot of each url; at equal times the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    names = [c for c in new.columns if c != "url"]
    return both.groupBy("url").agg(F.max_by(F.struct(*names), F.struct("fetched_at", "_new")).alias("x")).select("url", *[f"x.{c}" for c in names])


def live_snapshots(table: DataFrame, now: Column, days: int = SNAPSHOT_DAYS) -> DataFrame:
    """Those not yet past their time to live."""
    return table.filter(F.col("fetched_at") > now - F.expr(f"INTERVAL {days} DAYS"))
