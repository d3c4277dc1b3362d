"""Corpus pipeline: documents through toxicity, near-dedup, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` (what the stage before has kept) and returns the
columns of ``documents``; the last one adds ``shard`` and ``slot``. ``run`` writes each stage's result to the shared
folder, hands on what it reads there, and frees the result before it.

Defined results, in every stage: an empty table stays empty. Rows are judged one by one, so that of rows that repeat a
doc_id or have none each has its own result. Null and empty texts aren't toxic and hold no benchmark item; they are one
group of near copies, of which the smallest doc_id stays (a group without doc_ids keeps one row); they weigh one token
in mixing. Null sources and languages are values of their own. Ties: of a group of near copies the smallest doc_id stays,
of its rows with one text the one with the smallest hash of all columns. Extra columns go along under any name, but
``shard`` and ``slot``, which the last stage replaces. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, mixing, near_texts, sharding, toxicity
from quarry.llm.queries import mix_targets
from quarry.llm.shared import discard, keep

#: Share of the tokens that mixing keeps, and number of shards.
FRACTION, SHARDS = 0.8, 16


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; labels as in ``op1``."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return near_texts.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target shares of sources, languages and topics."""
    whole = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("record"))
    return mixing.mix(whole, mix_targets(spark), FRACTION).where("chosen").select("record.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in a random order, dealt to shards and slots."""
    return sharding.two_pass_shuffle(docs, SHARDS, size=F.coalesce(F.octet_length("text"), F.lit(0)))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Nearest-neighbour scores and fingerprints aren't SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if at:
            discard(before)
    return docs
