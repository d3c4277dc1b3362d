"""Snapshots: published whole or not at all, and views of which only stale parts are computed again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.operators.jobs import stale
from quarry.sources.folders import children, discard, keep, remove
from quarry.streaming.store import Keyed, VersionedStore


def _move(spark: SparkSession, source: str, target: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(source).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place(target).getParent())
    if not system.rename(place(source), place(target)):
        raise OSError(f"{source} couldn't become {target}")


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the snapshots that were published, in order; the last one is the current one."""
    found = children(spark, f"{path}/pointers")
    return [spark.read.parquet(found[n]).first()["snapshot"] for n in sorted(found, key=int) if "_SUCCESS" in children(spark, found[n])]


def read_snapshot(spark: SparkSession, path: str, table: str = "records", snapshot: str | None = None) -> DataFrame:
    """A table of a published snapshot (the current one): records, failures, skipped or manifest."""
    names = published(spark, path)
    if not names or (snapshot or names[-1]) not in names:
        raise FileNotFoundError(f"{path}: no such snapshot is published")
    folder = f"{path}/snapshots/{snapshot or names[-1]}"
    if table == "manifest":
        return spark.read.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/rows").where(F.col("fate") == table).drop("fate", *(["reason"] if table == "records" else []))


def publish(df: DataFrame, path: str, by: str, reject: Column | None = None, skip: Column | None = None, snapshot: str | None = None) -> str:
    """Publish ``df`` as a snapshot below ``path`` and return its name.

    Rows that ``skip`` marks are set aside; those for which ``reject`` gives a reason are failures, which stop no other
    row. All are written to a staging folder in one pass that counts them; the counts of what was written must be the
    same. The manifest has, for each value of ``by``, the numbers of records, failures and skipped rows. Then the folder
    is moved to its place, and a pointer, written last, makes it the current one. If anything breaks off before, nothing
    of it stays, and readers still see the snapshot before.
    """
    spark = df.sparkSession
    name = snapshot or f"snapshot-{uuid.uuid4().hex}"
    staging, output = f"{path}/staging/{name}", f"{path}/snapshots/{name}"
    if name in children(spark, f"{path}/snapshots"):
        raise FileExistsError(f"{output} is published already")
    reason = (F.lit(None) if reject is None else reject).cast("string")
    skipped = F.coalesce(F.lit(False) if skip is None else skip, F.lit(False))
    fate = F.when(skipped, "skipped").when(F.col("reason").isNotNull(), "failures").otherwise("records")
    seen = Observation("publish")
    rows = df.withColumn("reason", reason).withColumn("fate", fate).observe(seen, F.count("*").alias("rows"), F.count_if(F.col("fate") == "failures").alias("failures"))
    done = False
    try:
        rows.write.partitionBy("fate").parquet(f"{staging}/rows")
        if seen.get["rows"]:
            written = spark.read.schema(rows.schema).parquet(f"{staging}/rows")
            counts = [F.count_if(F.col("fate") == f).alias(f) for f in ("records", "failures", "skipped")]
            written.groupBy(by).agg(*counts).write.parquet(f"{staging}/manifest")
            total = spark.read.parquet(f"{staging}/manifest").agg(F.sum(F.col("records") + F.col("failures") + F.col("skipped")).alias("rows"), F.sum("failures").alias("failures")).first()
            if (total["rows"], total["failures"]) != (seen.get["rows"], seen.get["failures"]):
                raise ValueError(f"{name}: {total['rows']} rows and {total['failures']} failures were written, {seen.get['rows']} and {seen.get['failures']} were read")
        else:
            raise ValueError(f"{name}: there is nothing to publish")
        _move(spark, staging, output)
        number = max(map(int, children(spark, f"{path}/pointers")), default=0) + 1
        spark.createDataFrame([(name,)], "snapshot string").coalesce(1).write.parquet(f"{path}/pointers/{number}")
        done = True
    finally:
        if not done:
            remove(spark, staging, output)
    return name


def retire(spark: SparkSession, path: str, last: int = 2) -> list[str]:
    """Remove all but the last published snapshots; returns the names of those removed."""
    names = published(spark, path)
    old = [n for n in names if n not in names[-last:]]
    for number, pointer in children(spark, f"{path}/pointers").items():
        if "_SUCCESS" in children(spark, pointer) and spark.read.parquet(pointer).first()["snapshot"] in old:
            remove(spark, f"{path}/pointers/{number}")
    remove(spark, *[f"{path}/snapshots/{n}" for n in old])
    return old


def load_match_sources(spark: SparkSession, path: str, prefixes: dict[str, str], place: str) -> dict[str, DataFrame]:
    """The records of each source's latest published snapshot (source to the beginning of its snapshots' names).

    Records get ``set_slug`` and ``card_slug`` from the last two folders of their ``place``.
    """
    names = published(spark, path)
    out = {}
    for source, prefix in prefixes.items():
        own = sorted(n for n in names if n.startswith(prefix))
        if not own:
            raise FileNotFoundError(f"{path}: no snapshot {prefix}*")
        parts = F.split(F.regexp_replace(place, "/+$", ""), "/")
        out[source] = read_snapshot(spark, path, snapshot=own[-1]).withColumns({"set_slug": F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), "card_slug": F.element_at(parts, -1)})
    return out


def stamps_store(spark: SparkSession, path: str, buckets: int = 4) -> VersionedStore:
    """Versions of the parts of views."""
    return VersionedStore(spark, path, {"stamps": Keyed("part string, version long", ["part"])}, buckets)


def refresh_view(parts: DataFrame, key: str, version: int, path: str, stamps: VersionedStore, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute again the parts of a view (folders by ``key`` below ``path``) that are missing or of another version.

    ``compute`` gets the keys of the stale parts and returns their rows, ``key`` among the columns. Only the folders of
    these parts are written over; one that has no rows any more is removed. Stamps follow the data, so that a run which
    breaks off does its parts once more. Returns the keys that were stale.
    """
    spark = parts.sparkSession
    known = stamps.read("stamps").select(F.col("part").alias(key), "version")
    todo = keep(stale(parts.select(F.col(key).cast("string").alias(key)).distinct(), known, key, version), "stale")
    fresh = keep(compute(todo), "fresh")
    fresh.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    empty = todo.join(fresh.select(F.col(key).cast("string").alias(key)), key, "left_anti")
    held = {unquote(name): folder for name, folder in children(spark, path).items()}
    remove(spark, *[held[f"{key}={r[0]}"] for r in empty.collect() if f"{key}={r[0]}" in held])  # folders of parts
    stamps.commit((stamps.last() or 0) + 1, {"stamps": todo.select(F.col(key).alias("part"), F.lit(version).cast("long").alias("version"))})
    discard(fresh)
    return todo
