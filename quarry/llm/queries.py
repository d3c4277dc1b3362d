"""The queries opN_<name>: thin uses of the operators on whole tables, and DuckDB SQL where it can state one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import collocations, decontamination, merkle, mixing, neighbours, oracles, quality, revisits, secret_scan, sentence_pieces, sharding, simhash, substring_dedup, toxicity
from quarry.llm.shared import keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.records_of_pages(_table(spark, sf_dir, "pages")))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.select("record_id", "canonical", "kind", "status", "refers_to", "validator", F.concat_ws(";", fields).alias("headers"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_fingerprints(_table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secret_scan.dictionary_of(F.col("text"), _table(spark, sf_dir, "conversations"))
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), words)
    return found.select("doc_id", "start", "n_found", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).alias("is_secret"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    found = sharding.two_pass_shuffle(_table(spark, sf_dir, "documents"), shards=16, size=sharding.sizes(text))
    return found.select("doc_id", sharding.sizes(text).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_duplicates(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Target shares of tokens; relative within each dimension.
MIX = {
    "source": {f"src{k}": 1 + k % 3 / 4 for k in range(20)},
    "lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1},
    "topic": {"prose": 0.82, "table": 0.04, "marked": 0.06, "shouting": 0.04, "licensed": 0.04},
}
MIX_FRACTION = 0.4


def mix_targets(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: mixing.target_table(spark, shares) for name, shares in MIX.items()}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = mix_targets(spark)
    rows = mixing.described(_table(spark, sf_dir, "documents"), targets).select("doc_id", *targets, "tokens")
    found = mixing.decided(keep(rows, "tokens"), targets, MIX_FRACTION)
    return found.select("doc_id", "source", "lang", "topic", "tokens", F.round("rate", 6).alias("rate"), "chosen")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"), "worth")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    found = found.withColumn("items", items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = sentence_pieces.read_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    found = sentence_pieces.decode(sentence_pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(changed, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": text}, siblings=False)
    return found.withColumnRenamed("id", "doc_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_toxicity, op2_revisits, op3_simhash, op4_neighbours, op5_secrets, op6_sharding, op7_substring_dedup, op8_mixing, op9_quality, op10_decontamination, op11_sentence_pieces, op12_merkle_manifest, op13_collocations)}

ORACLES: dict[str, str] = {
    "op2_revisits": oracles.REVISITS,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_mixing": oracles.mixing(MIX, MIX_FRACTION),
    "op10_decontamination": oracles.DECONTAMINATION,
    "op12_merkle_manifest": oracles.MERKLE,
    "op13_collocations": oracles.COLLOCATIONS,
}
