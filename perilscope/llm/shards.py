"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly, by a seeded hash of their place in the
scan, into buckets of about ``bucket_bytes``. Pass two holds one bucket at a
time, shuffles it (Spark's ``shuffle`` is a Fisher-Yates shuffle) and writes it.
The buckets one after the other are one random order of all records; shard s
of n is the s-th of n equal stretches of it, so shards differ by one row at
most and no key, source or group of copies can fill a bucket or a shard.

Choose ``bucket_bytes`` by the memory of a task: a bucket is held in memory
about four times over. The rows must come from files or another source that
gives the same rows in the same order when a task is repeated; the written
buckets are what everything later reads.

Defined results: a null text has no bytes, rows with a null or repeated key and
equal rows are separate records, no rows give no rows, columns named like the
added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilscope.session import job_folder

BUCKET_BYTES = 16 << 20
ROW_BYTES = 8  # besides the text
SMALL_TABLE = 200_000  # buckets whose offsets are sent to every task (24 bytes each)


@dataclass
class Shuffled:
    """Written buckets: ``path`` holds the columns of the records, ``bucket`` and ``place``."""

    spark: SparkSession
    path: str
    columns: list[str]
    n_buckets: int

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def offsets(self) -> DataFrame:
        """Records before each bucket, and in all: one row per bucket."""
        counts = self.read().groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        total = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return counts.select(
            "bucket",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"),
            F.sum("rows").over(total).alias("total"),
        )

    def shards(self, n: int) -> DataFrame:
        """Records with ``shard`` (0 to n - 1) and ``slot`` (gapless from 0 in each)."""
        offsets = self.offsets()
        if self.n_buckets <= SMALL_TABLE:
            offsets = F.broadcast(offsets)
        at = F.col("first") + F.col("place")
        shard = F.expr("(first + place) * {n} div total".format(n=n))
        begins = F.expr("(shard * total + {n} - 1) div {n}".format(n=n))
        return (
            self.read().join(offsets, "bucket")
            .withColumn("shard", shard)
            .withColumn("slot", at - begins)
            .select(*self.columns, F.col("shard").cast("int").alias("shard"), "slot")
        )

    def write_shards(self, n: int, path: str) -> None:
        """One folder of Parquet files per shard. A bucket meets one or two shards, so few files are opened."""
        self.shards(n).write.partitionBy("shard").parquet(path)


def external_shuffle(
    docs: DataFrame, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES, path: str | None = None
) -> Shuffled:
    """Write all records in shuffled buckets below the shared folder (or to ``path``)."""
    spark = docs.sparkSession
    docs = docs.drop("bucket", "place", "shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES
    total = docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    record = F.monotonically_increasing_id()
    scattered = docs.withColumn("_record", record).withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "_record"), F.lit(n)).cast("int")
    )
    rows = F.sort_array(F.collect_list(F.struct("_record", *docs.columns)))
    buckets = (
        scattered.repartitionById(n, "bucket").groupBy("bucket")
        .agg(F.shuffle(rows, seed).alias("rows"))
        .select("bucket", F.posexplode("rows").alias("place", "row"))
        .select("row.*", "bucket", "place")
        .drop("_record")
    )
    path = path or job_folder(spark, "shuffled")
    buckets.write.option("compression", "zstd").parquet(path)
    return Shuffled(spark, path, docs.columns, n)
