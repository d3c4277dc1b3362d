"""Keyed choices and numberings: which row of a key wins, and in which order rows are counted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.folders import keep


def first_wins(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a stated order. Ranking is limited before the shuffle, so a hot key sends one row a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_wins(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row of the highest version of each key, folded map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def upsert(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``changes`` over ``df`` by key; one row of each key (later batches win over earlier ones)."""
    both = df.withColumn("_batch", F.lit(0)).unionByName(changes.withColumn("_batch", F.lit(1)))
    return latest_wins(both, keys, ["_batch"]).drop("_batch")


def override_map(changes: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """Latest value of each key; a null value deletes it."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(value), version).alias("_last"))
    return last.where(F.col(f"_last.{value}").isNotNull()).select(key, f"_last.{value}")


def numbered(df: DataFrame, family: Sequence[str], *order: Column | str, to: str = "place") -> DataFrame:
    """``to``: the row's place (from 1) within its family, whose rows may lie in any number of tasks.

    Rows are dealt out by range of family and order; a row's place is its place within its range and family, and the sum
    of what the ranges before hold of the family. There is a row for each range and family besides the rows themselves.
    """
    dealt = keep(df.repartitionByRange(*family, *order).withColumn("_range", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_range", *family).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*family).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_range").alias("_r"), *[F.col(f).alias(f"_f{k}") for k, f in enumerate(family)], before.alias("_before"))
    same = reduce(Column.__and__, [F.col("_range") == F.col("_r"), *[F.col(f).eqNullSafe(F.col(f"_f{k}")) for k, f in enumerate(family)]])
    place = F.row_number().over(Window.partitionBy("_range", *family).orderBy(*order)) + F.col("_before")
    return dealt.join(sizes, same).withColumn(to, place).drop("_range", "_r", "_before", *[f"_f{k}" for k in range(len(family))])


def running_before(df: DataFrame, value: str, *order: Column | str, to: str = "before") -> DataFrame:
    """``to``: the sum of ``value`` over all rows before, in a stated order, which many tasks share."""
    dealt = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "dealt")
    ahead = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias(value)).select("_range", ahead(Window.orderBy("_range")).alias("_ahead"))  # a row for each range
    return dealt.withColumn(to, ahead(Window.partitionBy("_range").orderBy(*order))).join(sums, "_range").withColumn(to, F.col(to) + F.col("_ahead")).drop("_range", "_ahead")


def assign_surrogate(df: DataFrame, family: str, base: int, *order: Column | str, to: str = "number") -> DataFrame:
    """``to``: base plus the row's place (from 1) within its family."""
    return numbered(df, [family], *order, to=to).withColumn(to, F.col(to) + base)


def chunk_queue(df: DataFrame, size: int, partition: str, *order: Column | str) -> DataFrame:
    """``chunk``: fixed-size pieces of each partition's queue, in order."""
    return numbered(df, [partition], *order, to="chunk").withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("int"))


def reproducible_sample(df: DataFrame, key: str, id_col: str, salt: str) -> DataFrame:
    """One row of each key, chosen by a salted hash: the same on every run."""
    draw = F.md5(F.concat_ws(":", F.lit(salt), F.col(key).cast("string"), F.col(id_col).cast("string")))
    return df.withColumn("_draw", draw).transform(lambda d: first_wins(d, [key], "_draw", id_col)).drop("_draw")


def top_k_counts(df: DataFrame, label: str, position: str, k: int = 8) -> DataFrame:
    """The k most frequent labels, ties by first appearance."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.min(position).alias("first_position")).orderBy(F.desc("n"), "first_position").limit(k)


def limit_distinct(df: DataFrame, key: str, n: int, unit: str, *order: str) -> DataFrame:
    """Rows up to the unit in which the n-th distinct key was first met; later rows of a met key are dropped too.

    Units are scanned in order of ``unit``; a unit counts as a whole. Keys first met in a unit stay only there.
    """
    firsts = first_wins(df, [key], unit, *order)
    fresh = firsts.groupBy(unit).agg(F.count("*").alias("_new"))
    early = running_before(fresh, "_new", unit, to="_before").where(F.col("_before") < n)
    return firsts.join(early.select(unit), unit, "left_semi")


def sort_rows(df: DataFrame, key: Column, position: str, descending: bool = False) -> DataFrame:
    """Sorted by a key; descending order is the exact reverse of ascending, ties too."""
    return df.orderBy(key.desc(), F.col(position).desc()) if descending else df.orderBy(key, position)
