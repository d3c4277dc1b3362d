"""Harvest runs: a list of jobs, each a set whose rows are read from its article; outcomes are kept and failures retried.

A run resolves every job's article, reads the set list of it, matches the rows to species, and gives for each job either
its rows and a progress row, or a failure with its reason and what was tried. ``run`` commits all three under one batch
number: a success takes an earlier failure out, a failure leaves earlier rows alone, and no job stops another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quarry.functions.text import title_variants
from quarry.operators.jobs import pending, retry_targets
from quarry.operators.match import best_or_ambiguous, match_prefix, scored_candidates
from quarry.operators.stages import Stage, first_found, resolve_in_stages
from quarry.sources.extract import setlist_rows
from quarry.sources.folders import discard, keep
from quarry.streaming.store import Keyed, VersionedStore

_ROWS = "array<struct<pos:int,number:string,name:string,species:string>>"
TABLES = {
    "results": Keyed(f"job string, title string, rows {_ROWS}", ["job"]),
    "progress": Keyed("job string, title string, method string, n_rows long, n_matched long", ["job"]),
    "failures": Keyed("job string, reason string, attempts array<string>, runs int", ["job"]),
}


def open_store(spark: SparkSession, path: str, buckets: int = 16) -> VersionedStore:
    """Results, progress and failures of the runs below a path."""
    return VersionedStore(spark, path, TABLES, buckets)


def search(pages: DataFrame, floor: float = 0.8) -> Stage:
    """A stage: the one page that shares most words with the job's title, if no other does as well."""

    def stage(jobs: DataFrame) -> DataFrame:
        wanted = jobs.select("job", F.col("title").alias("wanted"), F.lit(None).cast("string").alias("suffix"))
        titles = pages.select(F.col("title").alias("candidate"), F.col("title").alias("held"))
        scored = scored_candidates(wanted, titles, "job", "wanted", "candidate", "held", "suffix", bonus=0.0, floor=floor)
        return best_or_ambiguous(scored, "job", "candidate", "score", floor).where("status = 'hit'").select("job", F.col("candidate").alias("found"))

    return stage


def retry_stages(pages: DataFrame, overrides: DataFrame) -> list[tuple[str, Stage]]:
    """The ways to an article in order: the title, its variants, a title noted by hand (job, title), a search."""
    titles = pages.select("title")

    def noted(jobs: DataFrame) -> DataFrame:
        known = overrides.select("job", F.col("title").alias("found"))
        return jobs.select("job").join(known, "job").join(titles.withColumnRenamed("title", "found"), "found", "left_semi")

    return [
        ("direct", first_found([F.col("title")], titles, "title", "job")),
        ("variant", first_found([title_variants(F.col("title"))], titles, "title", "job")),
        ("override", noted),
        ("search", search(pages)),
    ]


def attempt(jobs: DataFrame, pages: DataFrame, stages: Sequence[tuple[str, Stage]], species: DataFrame) -> DataFrame:
    """Outcome of each job (job, title): article, method, rows, n_rows, n_matched, reason (null: done) and attempts.

    ``pages``: title, wikitext; ``species``: name and pos, see ``match_prefix``. A job without an article, or with one that
    has no text, fails. An article without rows is done with none.
    """
    found = resolve_in_stages(jobs.select("job", "title"), stages, "job").select("job", F.col("found").alias("article"), "method", F.concat(F.array("title"), title_variants(F.col("title"))).alias("tried"))
    texts = pages.select(F.col("title").alias("article"), "wikitext")
    # articles are parsed once, and by all tasks, however few bytes they have
    tasks = 2 * jobs.sparkSession.sparkContext.defaultParallelism
    read = keep(found.join(texts, "article", "left").select("job", "article", "method", "tried", "wikitext").repartition(tasks), "articles")
    rows = setlist_rows(read.where("wikitext is not null").select(F.col("job").alias("title"), "wikitext"))
    rows = keep(rows.select(F.col("title").alias("job"), "pos", "number", "name", F.concat_ws("/", "title", "pos").alias("row")), "rows")
    rows = match_prefix(rows, "row", "name", species, "name", "pos").select("job", F.struct("pos", "number", "name", F.col("matched").alias("species")).alias("r"))
    of_job = rows.groupBy("job").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    out = read.join(of_job, "job", "left").withColumn("rows", F.coalesce("rows", F.array().cast(_ROWS)))
    reason = F.when(F.col("article").isNull(), "no article").when(F.col("wikitext").isNull(), "no text")
    tried = F.col("tried") if len(stages) > 1 else F.slice("tried", 1, 1)
    matched = F.size(F.filter("rows", lambda r: r["species"].isNotNull()))
    return out.select(
        "job", F.col("article").alias("title"), "method", "rows", F.size("rows").cast("long").alias("n_rows"), matched.cast("long").alias("n_matched"),
        reason.alias("reason"), F.when(F.col("article").isNull(), tried).otherwise(F.array("article")).alias("attempts"),
    )


def run(store: VersionedStore, number: int, jobs: DataFrame, pages: DataFrame, stages: Sequence[tuple[str, Stage]], species: DataFrame) -> bool:
    """Attempt the jobs and commit their outcomes under ``number``; False if that number is committed already."""
    last = store.last()
    if last is not None and number <= last:
        return False
    outcome = keep(attempt(jobs, pages, stages, species), "outcomes")
    done, failed = outcome.where("reason is null"), outcome.where("reason is not null")
    runs = failed.join(store.read("failures").select("job", F.col("runs").alias("before")), "job", "left")
    cleared = done.select("job", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("array<string>").alias("attempts"), F.lit(0).alias("runs"), F.lit(True).alias("gone"))
    failures = runs.select("job", "reason", "attempts", (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("runs"), F.lit(False).alias("gone"))
    committed = store.commit(number, {"results": done.select("job", "title", "rows"), "progress": done.select("job", "title", "method", "n_rows", "n_matched"), "failures": failures.unionByName(cleared)})
    discard(outcome)
    return committed


def harvest_stream(jobs: DataFrame, store: VersionedStore, pages: DataFrame, stages: Sequence[tuple[str, Stage]], species: DataFrame, checkpoint: str) -> StreamingQuery:
    """A stream of jobs (job, title): every micro-batch attempts those that aren't done, and commits as one."""

    def write(batch: DataFrame, number: int) -> None:
        run(store, number, pending(batch, store.read("progress"), ["job"], ["job"]), pages, stages, species)

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry(store: VersionedStore, number: int, jobs: DataFrame, pages: DataFrame, overrides: DataFrame, species: DataFrame) -> bool:
    """Attempt once more what has failed or has given no rows, in all ways; jobs that are listed no more are left as they are."""
    targets = retry_targets(store.read("failures"), store.read("progress"), "job", "n_rows")
    return run(store, number, jobs.join(targets, "job", "left_semi"), pages, retry_stages(pages, overrides), species)


def states(jobs: DataFrame, store: VersionedStore) -> DataFrame:
    """Each job's state: done, failed or pending, with what is known of it."""
    out = jobs.select("job").join(store.read("progress").drop("title"), "job", "left").join(store.read("failures"), "job", "left")
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.col("n_rows").isNotNull(), "done").otherwise("pending")
    return out.withColumn("status", status)

