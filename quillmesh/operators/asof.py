"""As-of joins: for every row of one history the latest row of another one, by key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of one key that one task merges; longer histories are cut into ranges of time
TOGETHER = 1_000_000
#: ranges that the history of one key is cut into at most, so that their bounds stay few
MOST_RANGES = 10_000


def _ranges(rows: DataFrame, keys: list[str], together: int) -> DataFrame | None:
    """(keys, cuts): for keys of more rows than go together, times that cut their history into even ranges.

    There are at most as many such keys as the table has times ``together`` rows; None if there are none.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > together)
    if counts.isEmpty():
        return None
    hot = rows.join(counts.select(*keys), keys, "left_semi").select(*keys, F.unix_micros("_t").alias("_t"))
    shares = counts.select(*keys, F.least(F.ceil(F.col("_n") / together), F.lit(MOST_RANGES)).cast("int").alias("_k"))
    most = shares.agg(F.max("_k")).first()[0]
    marks = hot.groupBy(*keys).agg(F.percentile_approx("_t", [k / most for k in range(1, most)], 10 * most).alias("_m")) if most > 1 else None
    return None if marks is None else marks.select(*keys, F.array_sort(F.array_distinct("_m")).alias("_cuts"))


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, found_at: str, carried: dict[str, str], *,
    strict: bool = False, tie: str | None = None, within: str | None = None, together: int = TOGETHER,
) -> DataFrame:
    """All rows and columns of ``left``, with columns of the latest row of ``right`` of the same keys.

    ``carried`` names the columns of ``right`` and what they are called in the result.  ``right`` rows
    count up to the time of the left row (``at`` and ``found_at`` are timestamps), or with ``strict`` before it.  Of
    rows of one key and time the greatest ``tie`` counts (without it, the greatest carried values).
    ``within`` (an interval, as "30 DAYS") leaves out what is older.  Null keys and times match nothing;
    repeated left rows stay repeated; without a match the columns are null.  A column name that both
    sides would give is refused with a ValueError.

    Both histories are merged in one sort: a window carries the last right row on to the left rows that
    follow.  A key whose history is long is cut into ranges of time, each merged by a task of its own;
    what is last in a range is carried over to the ranges after it.
    """
    clash = [c for c in carried.values() if c in left.columns]
    if clash:
        raise ValueError(f"the left table already has the columns {', '.join(clash)}")
    names = [f"_k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names)]
    said = F.struct(F.col(found_at).alias("_found"), *[F.col(c).alias(n) for c, n in carried.items()])
    usable = F.lit(True)
    for k in [*keys, found_at]:
        usable = usable & F.col(k).isNotNull()
    first = F.struct(*([F.col(tie)] if tie else []), *[F.col(c) for c in carried])
    # of one key and time one row can be found, so times that many rows share are reduced before they travel
    ends = right.filter(usable).groupBy(*own, F.col(found_at).alias("_t")).agg(F.max_by(said, first).alias("_r"))
    asks = left.select(*own, F.col(at).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    both = asks.withColumns({"_r": F.lit(None).cast(ends.schema["_r"].dataType), "_side": F.lit(0 if strict else 1)})
    both = both.unionByName(ends.withColumns({"_l": F.lit(None).cast(asks.schema["_l"].dataType), "_side": F.lit(1 if strict else 0)}))
    cuts = _ranges(both.filter(F.col("_t").isNotNull()), names, together)
    last = F.last("_r", ignorenulls=True)
    if cuts is None:
        w = Window.partitionBy(*names).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        merged = both.withColumn("_x", last.over(w))
    else:
        after = F.size(F.filter("_cuts", lambda c: c < F.unix_micros("_t")))
        cut = both.join(cuts, names, "left").withColumn("_b", F.coalesce(F.when(F.col("_cuts").isNotNull(), after), F.lit(0))).drop("_cuts")
        w = Window.partitionBy(*names, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        kept = cut.filter("_r IS NOT NULL").groupBy(*names, "_b").agg(F.max_by("_r", "_t").alias("_c"))
        # every range of a long history has a row here, also one without a right row of its own
        every = cuts.select(*names, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_b")).join(kept, [*names, "_b"], "left")
        carry = every.select(*names, "_b", F.last("_c", ignorenulls=True).over(before).alias("_c"))
        merged = cut.withColumn("_x", last.over(w)).join(carry, [*names, "_b"], "left").withColumn("_x", F.coalesce("_x", "_c"))
    old = F.lit(False) if within is None else F.coalesce(F.col("_x._found") < F.col("_t") - F.expr(f"INTERVAL {within}"), F.lit(True))
    blind = F.col("_t").isNull() | old
    for n in names:
        blind = blind | F.col(n).isNull()
    rows = merged.filter("_l IS NOT NULL").select(F.col("_l"), F.when(~blind, F.col("_x")).alias("_x"))
    return rows.select("_l.*", *[F.col(f"_x.{c}").alias(c) for c in carried.values()])


def snapshots_as_of(asked: DataFrame, history: DataFrame, *, days: int, together: int = TOGETHER) -> DataFrame:
    """``asked`` (url, at, and more) with the snapshot of each url that was live at that time.

    ``history`` holds every snapshot ever taken (url, fetched_at, content_hash); one older than ``days``
    at the asked time is not live any more.  Added: snapshot_at and content_hash, null where there was none.
    """
    return asof_join(asked, history, ["url"], "at", "fetched_at", {"fetched_at": "snapshot_at", "content_hash": "content_hash"}, within=f"{days} DAYS", together=together)
