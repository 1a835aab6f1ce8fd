"""The stored table of snapshots: one folder per bucket of urls, of which an update rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.diff import SNAPSHOT_DAYS, live_snapshots, upsert_snapshots
from quillmesh.operators.settling import settled

BUCKETS = 256


class SnapshotStore:
    """Snapshots (url, fetched_at and more) as Parquet under ``path``, partitioned by a hash of the url.

    One writer at a time is assumed, as for any Parquet table.  A store is always opened with the number of
    buckets that it was first written with; choose it so that a bucket is some 100 MB.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def read(self, urls: DataFrame) -> DataFrame:
        """The snapshots of some urls (url): only their buckets are read."""
        wanted = urls.select("url").distinct()
        touched = [r[0] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket").join(wanted, "url", "left_semi")

    def live(self, now: Column, days: int = SNAPSHOT_DAYS) -> DataFrame:
        return live_snapshots(self.table(), now, days)

    def upsert(self, new: DataFrame) -> int:
        """Stores snapshots: of each url the latest stays, at equal times the new one.  Returns how many buckets were rewritten.

        Rows with a null url are refused by a ValueError; repeated urls count once, the latest of them.
        """
        fresh = settled(new.withColumn("bucket", self._bucket()))
        if not fresh.filter("url IS NULL").isEmpty():
            raise ValueError("snapshots without a url can't be stored")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        if not touched:
            return 0
        if self.exists():
            stored = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).select(fresh.columns)
        else:
            stored = fresh.limit(0)
        # settled before the folders that it was read from are replaced
        latest = settled(upsert_snapshots(stored.drop("bucket"), fresh.drop("bucket")).withColumn("bucket", self._bucket()))
        latest.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return len(touched)

    def expire(self, now: Column, days: int = SNAPSHOT_DAYS) -> int:
        """Rewrites the buckets that hold snapshots past their time to live without these; returns how many."""
        every = self.spark.read.parquet(self.path)
        old = every.filter(F.col("fetched_at") <= now - F.expr(f"INTERVAL {days} DAYS"))
        touched = [r[0] for r in old.select("bucket").distinct().collect()]
        if not touched:
            return 0
        rest = settled(live_snapshots(every.filter(F.col("bucket").isin(touched)), now, days))
        kept = {r[0] for r in rest.select("bucket").distinct().collect()}
        if kept:
            rest.repartition(len(kept), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in set(touched) - kept:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)
        return len(touched)
