"""A keyed table in hash buckets, changed by copying only the buckets that a change touches.

A version is a manifest: for each bucket the folders that hold its rows, their number, and the oldest sighting of an offer in
stock.  A change writes to a folder of its own the buckets in which a key was there before, whole, and of the others only the new
rows, and then its manifest, whose success mark makes it valid; folders of other versions are never written to.  A change that failed, or that runs again, starts from the
version before it and gives the same rows.  What is written grows with the buckets touched, not with the table; the driver
sees one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import KEY, stale_marked
from ..store import kept

STATE = "shop_id string, item_id string, name string, price long, url string, in_stock boolean, last_seen_at timestamp, match_status string, part_id string"
#: Of so many folders a bucket is made one again by the next change.
FOLDERS = 16
MANIFEST = "bucket int, folder string, rows long, oldest timestamp, buckets int"


class BucketedState:
    """Versions under ``root``, named by texts in whose order they follow one another."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        last = self.latest()
        first = self._manifest(last).first() if last else None
        self.buckets = first["buckets"] if first else buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def latest(self, before: str | None = None) -> str | None:
        """The last valid version (before a name), found through Spark's own file system."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/*/_SUCCESS")
        hits = found.getFileSystem(conf).globStatus(found)
        names = [h.getPath().getParent().getName() for h in hits or []]
        return max((n for n in names if before is None or n < before), default=None)

    def _manifest(self, version: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{version}")

    def entries(self, version: str | None) -> dict[int, tuple]:
        """One row of the manifest for each bucket that has rows."""
        return {r["bucket"]: tuple(r) for r in self._manifest(version).collect()} if version else {}

    def rows(self, entries: dict[int, tuple]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*(f"{self.root}/{folder}" for e in entries.values() for folder in e[1].split()))

    def captured(self, version: str | None) -> DataFrame:
        """Rows that a version wrote with what is to be noted of them (``captured``); none without a version."""
        schema = f"{STATE}, captured struct<in_stock: boolean>"
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self.folder(version)}/*").where("captured is not null")

    def read(self, version: str | None = None) -> DataFrame:
        return self.rows(self.entries(version or self.latest()))

    def known(self, entries: dict[int, tuple], keys: DataFrame) -> set[int]:
        """The buckets that a change of these keys writes whole: those that hold one of them, or are in many folders already.

        Keys are compared by their hash, which is narrow; two with one hash are only taken for one.
        """
        many = {b for b, e in entries.items() if len(e[1].split()) >= FOLDERS}
        mark = F.xxhash64(*KEY).alias("mark")
        there = self.rows({b: e for b, e in entries.items() if b not in many}).select(mark)
        met = there.join(keys.select(mark), "mark", "left_semi").select(F.pmod("mark", F.lit(self.buckets)).cast("int").alias("bucket"))
        return many | {r[0] for r in met.distinct().collect()} if len(many) < len(entries) else many

    def added(self, old: tuple | None, new: tuple) -> tuple:
        """The entry of a bucket to which rows were added."""
        if old is None:
            return new
        seen = [t for t in (old[3], new[3]) if t is not None]
        return (new[0], f"{old[1]} {new[1]}", old[2] + new[2], min(seen, default=None), self.buckets)

    def write(self, version: str, changed: DataFrame) -> dict[int, tuple]:
        """Writes rows of buckets: these buckets' entries of a manifest.

        changed: rows, with their bucket if they are together by bucket already.
        """
        folder = self.folder(version)
        placed = changed if "bucket" in changed.columns else changed.withColumn("bucket", self.bucket()).repartition("bucket")
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        oldest = F.min(F.when(F.col("in_stock"), F.col("last_seen_at")))
        written = self.spark.read.schema(f"{STATE}, bucket int").parquet(f"{self.root}/{folder}")
        stats = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), oldest.alias("oldest")).collect()
        return {r["bucket"]: (r["bucket"], f"{folder}/bucket={r['bucket']}", r["rows"], r["oldest"], self.buckets) for r in stats}

    def folder(self, version: str) -> str:
        return f"data/{version}"

    def commit(self, version: str, entries: dict[int, tuple]) -> None:
        """Writes the manifest, which makes the version valid."""
        self.spark.createDataFrame(list(entries.values()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version}")

    def mark_stale(self, version: str, now: str, shops: DataFrame) -> int:
        """A version in which offers of the shops that were not seen lately are out of stock; how many rows were marked.

        shops: shop_id of the shops whose source gave any rows; an empty source says nothing about its shop's offers.  Only
        buckets whose oldest offer in stock is old enough are read, and only those in which something is marked are written.
        """
        entries, at = self.entries(self.latest(version)), F.lit(now).cast("timestamp")
        limit = self.spark.range(1).select((at - F.expr("INTERVAL 3 DAYS")).alias("t")).first()["t"]
        old = {b: e for b, e in entries.items() if e[3] is not None and e[3] < limit}
        # a table of its own, whose size is known before it is joined
        seen = kept(shops.select("shop_id").distinct()).withColumn("__seen", F.lit(True))
        marked = stale_marked(self.rows(old).withColumn("was", F.col("in_stock")), at).join(seen, "shop_id", "left")
        hit = F.col("stale") & F.coalesce("__seen", F.lit(False)) & F.col("was")
        done = marked.withColumn("hit", hit).withColumn("in_stock", F.when(F.col("hit"), False).otherwise(F.col("was")))
        hits = {r["bucket"]: r["n"] for r in done.where("hit").groupBy(self.bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}
        # rows come from their buckets' files, so they are together already
        if hits:
            entries |= self.write(version, done.withColumn("bucket", self.bucket()).where(F.col("bucket").isin(list(hits))).select(*self.rows({}).columns, "bucket"))
        self.commit(version, entries)
        return sum(hits.values())
