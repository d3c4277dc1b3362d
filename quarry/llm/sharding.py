"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters the records over memory-sized buckets by a seeded hash. Pass two shuffles each bucket with Spark's
``shuffle`` (Fisher-Yates, seeded) and writes it to the shared folder. Buckets one after another are one random order of
all records; record number i of it goes to shard ``i mod shards``, slot ``i div shards``. This is the law ``rows``:
shards' counts differ by one at most, and slots have no gap.

A record's hash takes its number within the input partition besides its id, so that rows which repeat an id (or whole
rows that repeat) scatter like any others: no bucket depends on how often a value occurs. The order is fixed by the
seed, the input files and how Spark splits them; once written, it doesn't change when a task runs again. A hash of a
bucket's number names its partition, where buckets follow in order of their numbers; that fixes the random numbers that
each one's shuffle draws.

Defined results: null ids and null columns are records like any other; an empty table gives no rows; other columns
travel with their record under their own names, and those named shard or slot are replaced.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import keep

#: Buckets whose first places (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20


def sizes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def two_pass_shuffle(df: DataFrame, shards: int, id_col: str = "doc_id", size: Column | None = None, bucket_bytes: float = 8e6, seed: int = 6) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0 in each shard).

    ``size``: bytes of a record in memory, to choose the number of buckets; 64 bytes if not given.
    """
    if shards < 1:
        raise ValueError("shards: 1 or more")
    df = df.drop("shard", "slot")
    total = df.agg(F.sum(F.lit(64) if size is None else size + 64).alias("n")).first()[0] or 0
    buckets = max(1, ceil(total / bucket_bytes))
    number = F.monotonically_increasing_id()
    scattered = df.select(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), number), F.lit(buckets)).alias("bucket"), F.xxhash64(F.lit(seed + 1), F.col(id_col), number).alias("key"), F.struct(*[df[c] for c in df.columns]).alias("record"))
    # whole buckets by partition, records in an order that doesn't depend on how they arrived
    gathered = scattered.repartition(buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "record")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("records"))
    shuffled = keep(gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", seed).alias("records")), "shuffled-buckets")
    counts = shuffled.select("bucket", F.size("records").cast("long").alias("n"))
    # a row for each bucket, not for each record
    before = counts.withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "begin")
    before = F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before  # records aren't shuffled again
    numbered = shuffled.join(before, "bucket").select("begin", F.posexplode("records").alias("at", "r"))
    place = F.col("begin") + F.col("at")
    return numbered.select("r.record.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write sharded rows as one folder for each shard, in slot order within each file."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
