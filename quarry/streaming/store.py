"""Keyed tables on files that change batch by batch: all tables of a batch at once, and only the buckets it touches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.keyed import latest_wins
from quarry.sources.folders import children, remove

_MANIFEST = "name string, bucket int, batch long"


@dataclass(frozen=True)
class Keyed:
    """A table of a store: its columns, its key, and the columns whose greatest values win (none: the last batch)."""

    schema: str
    keys: Sequence[str]
    version: Sequence[str] = ()


class VersionedStore:
    """Tables below one path. A commit carries a number and changes of several tables.

    Rows lie in buckets by a hash of their key. A commit writes the touched buckets anew below its own number, then a
    manifest that names, for each bucket, the commit which holds it; readers go by the last whole manifest, so that they
    see all tables of a commit or none. A number that isn't above the last committed one changes nothing: a replayed
    batch is skipped, and one that broke off is written over. Buckets that a commit has replaced stay until the next one,
    for those who still read them. A manifest has a row for each table and bucket, whatever the tables' sizes.
    """

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Keyed], buckets: int = 16):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), dict(tables), buckets

    def _commits(self) -> list[int]:
        """Numbers of whole manifests, ascending."""
        found = children(self.spark, f"{self.path}/manifest")
        return sorted(int(name.split("=")[1]) for name, path in found.items() if "_SUCCESS" in children(self.spark, path))

    def _manifest(self, number: int) -> dict[tuple[str, int], int]:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/commit={number}").collect()
        return {(r["name"], r["bucket"]): r["batch"] for r in rows}

    def last(self) -> int | None:
        """The number of the last commit."""
        return (self._commits() or [None])[-1]

    def _folder(self, name: str, bucket: int, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}/bucket={bucket}"

    def _read(self, name: str, held: Mapping[tuple[str, int], int], buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [self._folder(*key, batch) for key, batch in held.items() if key[0] == name and (buckets is None or key[1] in buckets)]
        table = self.tables[name]
        return self.spark.read.schema(table.schema).parquet(*paths) if paths else self.spark.createDataFrame([], table.schema)

    def read(self, name: str) -> DataFrame:
        """The table as of the last commit."""
        last = self.last()
        return self._read(name, {} if last is None else self._manifest(last))

    def commit(self, number: int, changes: Mapping[str, DataFrame]) -> bool:
        """Put changes in, in place of rows of their keys; rows whose column ``gone`` is true take theirs out. False: was there before.

        Of several changes of a key the one with the greatest version counts, and none that is older than the held row.
        """
        commits = self._commits()
        if commits and number <= commits[-1]:
            return False
        held = self._manifest(commits[-1]) if commits else {}
        after = dict(held)
        for name, change in changes.items():
            table = self.tables[name]
            columns = self.spark.createDataFrame([], table.schema).columns
            bucket = F.pmod(F.hash(*table.keys), F.lit(self.buckets))
            if "gone" not in change.columns:
                change = change.withColumn("gone", F.lit(False))
            fresh = change.select(*columns, "gone", F.lit(1).alias("late"))
            touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
            if not touched:
                continue
            kept = self._read(name, held, touched).select(*columns, F.lit(False).alias("gone"), F.lit(0).alias("late"))
            rows = latest_wins(kept.unionByName(fresh), table.keys, [*table.version, "late"]).where(~F.col("gone")).drop("gone", "late")
            rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={number}")
            full = children(self.spark, f"{self.path}/{name}/batch={number}")
            for b in touched:
                after.pop((name, b), None)
                if f"bucket={b}" in full:  # else all its rows have gone
                    after[name, b] = number
        rows = [(name, b, batch) for (name, b), batch in after.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/commit={number}")
        if len(commits) > 1:
            before = self._manifest(commits[-2])
            remove(self.spark, *[self._folder(*key, batch) for key, batch in before.items() if held.get(key) != batch], f"{self.path}/manifest/commit={commits[-2]}")
        return True
