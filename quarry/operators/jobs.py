"""Resumable work: job lists, progress, retries, stale parts, and set operations between lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import slugify
from quarry.operators.keyed import first_wins, upsert


def species_scope(species: DataFrame, group: str, chosen: Sequence, order: str) -> DataFrame:
    """Species of the chosen groups, by number."""
    return species.where(F.col(group).isin(*chosen)).orderBy(order)


def discover_new(known: DataFrame, found: DataFrame, title: str, suffix: str) -> DataFrame:
    """Found titles with the suffix that aren't known, whatever their case, with a key: slug, then slug-2, slug-3, ..."""
    have = known.select(F.lower(title).alias("_t")).distinct()
    fresh = first_wins(found.where(F.col(title).endswith(suffix)).withColumn("_t", F.lower(title)), ["_t"], title).join(have, "_t", "left_anti").drop("_t")
    slug = slugify(F.col(title), "-")
    taken = known.select(slug.alias("slug")).groupBy("slug").agg(F.count("*").alias("_taken"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy(title)) + F.coalesce("_taken", F.lit(0))
    return fresh.withColumn("slug", slug).join(taken, "slug", "left").withColumn("_n", place).select(title, F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "_n")).alias("key"))


def enrichment_jobs(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """Full outer join of two issue lists by group: flags and the sorted distinct items."""
    x = a.groupBy(group).agg(F.collect_set(item).alias("_a"))
    y = b.groupBy(group).agg(F.collect_set(item).alias("_b"))
    none = F.array().cast(x.schema["_a"].dataType)
    out = x.join(y, group, "full")
    return out.select(group, F.col("_a").isNotNull().alias("needs_a"), F.col("_b").isNotNull().alias("needs_b"), F.array_sort(F.array_union(F.coalesce("_a", none), F.coalesce("_b", none))).alias("items"))


def missing_set_jobs(manifest: DataFrame, entries: str, title: str) -> DataFrame:
    """Exploded gap manifest with ``status``: job, or unresolved where an entry has no title."""
    rows = manifest.withColumn("_e", F.explode(entries)).select("*", "_e.*").drop("_e", entries)
    return rows.withColumn("status", F.when(F.nullif(F.col(title), F.lit("")).isNull(), "unresolved").otherwise("job"))


def append_new(current: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """``current`` plus the defaults whose key it lacks; edits stay."""
    return current.unionByName(defaults.join(current.select(key), key, "left_anti").select(*current.columns))


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Jobs that aren't done, in order, at most ``limit``."""
    rest = jobs.join(done.select(*keys).distinct(), list(keys), "left_anti").orderBy(*order)
    return rest if limit is None else rest.limit(limit)


def retry_targets(failed: DataFrame, completed: DataFrame, key: str, n_rows: str) -> DataFrame:
    """Failed jobs and those that completed with no rows, once each."""
    return failed.select(key).unionByName(completed.where(F.col(n_rows) == 0).select(key)).distinct()


def mark_done(progress: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Progress with new entries over old ones."""
    return upsert(progress, entries, keys)


def stale(parts: DataFrame, stamps: DataFrame, key: str, version) -> DataFrame:
    """Derived parts that are missing or of another version."""
    return parts.join(stamps.select(key, F.col("version").alias("_v")), key, "left").where(~F.coalesce(F.col("_v") == version, F.lit(False))).drop("_v")


def invalidate(df: DataFrame, language: str, covered: DataFrame, known_version: Column, new_version: Column) -> DataFrame:
    """``df`` without covered languages when a new, known version differs from the stored one; else unchanged."""
    gone = covered.select(language).distinct().withColumn("_c", F.lit(True))
    drop = F.col("_c").isNotNull() & new_version.isNotNull() & ~F.coalesce(known_version.eqNullSafe(new_version), F.lit(False))
    return df.join(gone, language, "left").where(~drop).drop("_c")


def rewrite_urls(df: DataFrame, field: str, checkpoint: DataFrame, target: Column, by: Sequence[str] = ()) -> DataFrame:
    """``field`` replaced by ``target`` where the checkpoint (url, status) says done; ``rewritten`` tells which.

    ``by``: columns of both that tell apart the rows of one URL, each with a status of its own.
    """
    done = checkpoint.where(F.col("status") == "done").select(F.col("url").alias(field), *by).distinct().withColumn("_done", F.lit(True))
    out = df.join(done, [field, *by], "left").withColumn("rewritten", F.col("_done").isNotNull())
    return out.withColumn(field, F.when(F.col("rewritten"), target).otherwise(F.col(field))).drop("_done")


def rewrite_fields(df: DataFrame, fields: dict[str, Column], external: Callable[[Column], Column], checkpoint: DataFrame) -> DataFrame:
    """Each field's URL replaced by its target where it is external and the checkpoint (url, status) says done.

    ``fields``: name to the column of what takes its place. ``changes`` has an entry (field, old, new) for each replaced one.
    """
    done = checkpoint.where(F.col("status") == "done").select("url").distinct()
    out = df
    for k, name in enumerate(fields):
        out = out.join(done.select(F.col("url").alias(name), F.lit(True).alias(f"_done{k}")), name, "left")
    hit = {name: F.coalesce(F.col(f"_done{k}") & external(F.col(name)), F.lit(False)) for k, name in enumerate(fields)}
    change = [F.when(hit[name], F.struct(F.lit(name).alias("field"), F.col(name).alias("old"), new.alias("new"))) for name, new in fields.items()]
    out = out.withColumn("changes", F.array_compact(F.array(*change)))
    return out.select(*[F.when(hit[c], fields[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns], "changes")


def rewrite_summary(rewritten: DataFrame, file: str) -> DataFrame:
    """One row: how many fields and how many files have changed."""
    changed = rewritten.where(F.size("changes") > 0)
    return changed.agg(F.coalesce(F.sum(F.size("changes")), F.lit(0)).alias("fields"), F.countDistinct(file).alias("files"))


def rewrite_samples(rewritten: DataFrame, file: str, key: str, most: int = 60) -> DataFrame:
    """The first changed fields by file and key: file, key, field, old, new."""
    return rewritten.select(file, key, F.posexplode("changes").alias("_at", "c")).select(file, key, "_at", "c.*").orderBy(file, key, "_at").limit(most).drop("_at")


def mirror_worklist(urls: DataFrame, checkpoint: DataFrame, url: str) -> DataFrame:
    """Distinct URLs that were neither done nor failed before."""
    return urls.select(url).distinct().join(checkpoint.select(F.col("url").alias(url)), url, "left_anti")


def full_history(metadata: DataFrame, refreshes: DataFrame, key: str) -> DataFrame:
    """Completeness flag by part: a full load sets it, a partial refresh clears it; the last refresh counts."""
    last = refreshes.groupBy(key).agg(F.max_by("kind", "seq").alias("_k"))
    out = metadata.join(last, key, "left")
    return out.select(key, F.when(F.col("_k") == "full", True).when(F.col("_k") == "partial", False).otherwise(F.col("complete")).alias("complete"))


def run_outcomes(jobs: DataFrame, results: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """After a run: each job's status, rows and failed attempts. Success clears what has failed before; one bad job stops no other."""
    ok = results.groupBy(key).agg(F.count("*").alias("n_rows"))
    bad = failures.groupBy(key).agg(F.count("*").alias("attempts"), F.max_by("reason", "attempt").alias("reason"))
    out = jobs.join(ok, key, "left").join(bad, key, "left")
    status = F.when(F.col("n_rows").isNotNull(), "done").when(F.col("attempts").isNotNull(), "failed").otherwise("pending")
    out = out.withColumn("status", status).withColumns({c: F.when(F.col("status") == "failed", F.col(c)) for c in ("reason", "attempts")})
    return out.na.fill(0, ["n_rows", "attempts"])

