"""The pipeline's stages against plain Python, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_texts import by_brute_force, texts
from test_text_operators import hits

from quarry.llm import mixing, queries, toxicity

DATA = "/root/testdata/sf0.001"


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, DATA)
    scores = toxicity.score(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert clean.columns == columns and ids(clean) == ids(scores.where("score < 0.5"))

    clean = clean.cache()
    single = stages["near_dedup"](spark, clean, DATA)
    assert single.columns == columns and ids(single) == sorted({c for _, c in by_brute_force(texts(clean))[0]}, key=repr)

    single = single.cache()
    fresh = stages["decontamination"](spark, single, DATA)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = [h[0] for h in hits([tuple(r) for r in single.select("doc_id", "text").collect()], items) if not h[-1]]
    assert fresh.columns == columns and ids(fresh) == sorted(want, key=repr)

    fresh = fresh.cache()
    chosen = stages["mixing"](spark, fresh, DATA)
    rates = mixing.mix(fresh, queries.mix_targets(spark), corpus_pipeline.FRACTION)
    assert chosen.columns == columns and ids(chosen) == ids(rates.where(mixing.uniform(F.col("doc_id")) < F.col("rate")))

    chosen = chosen.cache()
    placed = stages["sharding"](spark, chosen, DATA)
    assert placed.columns == [*columns, "shard", "slot"] and ids(placed) == ids(chosen)
    counts = [r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(counts) - min(counts) <= 1


def test_stages_on_odd_rows(spark, odd, empty):
    """Nulls, repeats, long texts, clashing columns and empty tables go through every stage."""
    for df in (odd.withColumn("source_cell", F.lit("clash")), empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DATA)
            added = {"shard", "slot"} if name == "sharding" else set()
            assert set(out.columns) == set(df.columns) | added
            kept, rows = out.count(), df.count()
            if name in ("toxicity", "decontamination", "sharding"):
                assert kept == rows
            elif name == "near_dedup":
                assert kept == (by_brute_force(texts(df))[1] if rows else 0)
            else:
                assert kept <= rows
            if name == "mixing" and kept:  # what stays is as it was
                assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows, given = out.collect(), {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert rows and all(given[r["doc_id"]] == tuple(r)[:-2] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
