"""Incremental import: landed offer files as a stream, merged into a state table batch by batch.

Each micro-batch is shuffled once, with the buckets of the state that hold any of its keys: of equal keys the last row wins.  It is
written as these buckets' new version, and as additions to others, from which the rows of the price history are read, all named by the batch's number: a
batch that runs again after a failure overwrites its own files, so results are the same as without the failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import KEY, upserted_in
from .state import BucketedState

OFFER = "shop_id string, item_id string, name string, price double, url string, in_stock boolean, last_seen_at timestamp"
#: Rows of a bucket that one task merges, about: a larger bucket is dealt among several, so that none sorts more than fits in memory.
ROWS_A_TASK = 400_000


class OfferImport:
    """A state table in versions under ``root``, and the stream that writes it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.table = BucketedState(spark, f"{self.root}/state", buckets)

    def write_batch(self, batch: DataFrame, number: int) -> None:
        """State version ``number`` from the version before it and the batch's rows."""
        version, folder = f"{number:08d}", f"{self.root}/history/batch={number}"
        incoming = batch.where("shop_id is not null and item_id is not null").withColumn("bucket", self.table.bucket())
        # one row for each bucket at most
        touched = {r[0]: r[1] for r in incoming.groupBy("bucket").count().collect()}
        entries = self.table.entries(self.table.latest(version))
        if touched:
            old = {b: e for b, e in entries.items() if b in touched}
            parts = -(-max(n + (old[b][2] if b in old else 0) for b, n in touched.items()) // ROWS_A_TASK)
            whole = self.table.known(old, incoming)
            existing = self.table.rows({b: e for b, e in old.items() if b in whole}).withColumn("bucket", self.table.bucket())
            written = self.table.write(version, upserted_in("bucket", existing, incoming, dealt=(parts, parts * len(touched)), captured=True))
            entries |= {b: e if b in whole else self.table.added(old.get(b), e) for b, e in written.items()}
        # what changed is told by the rows that were written, so that nothing is joined or shuffled for it
        rows = self.table.captured(version if touched else None)
        rows.select(*KEY, "price", "captured.in_stock", F.col("last_seen_at").alias("captured_at")).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        self.table.commit(version, entries)

    def run(self, source: str, files_per_batch: int = 1000) -> None:
        """Merges all files of ``source`` (Parquet with OFFER's columns) that earlier runs have not seen."""
        stream = self.spark.readStream.schema(OFFER).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def state(self) -> DataFrame:
        return self.table.read()

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/history")

    def age(self, now: str, shops: DataFrame) -> int:
        """Marks offers that were not seen lately as out of stock; shops: shop_id of those whose source gave rows in this run."""
        last = self.table.latest()
        return self.table.mark_stale(f"{last}-aged", now, shops) if last else 0
