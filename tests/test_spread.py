"""Numbering and candidate search where one family, token or run of characters has nearly all rows."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import keyed as K
from quarry.operators import match as X
from quarry.sources import catalog as S


@pytest.fixture
def in_ranges(spark):
    """Ranges stay apart, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_family_is_numbered_by_many_tasks(spark, in_ranges):
    rows = spark.range(4000).select(F.when(F.col("id") % 50 == 0, F.lit(None).cast("string")).otherwise("hot").alias("f"), (4000 - F.col("id")).alias("o")).repartition(7)
    found = K.numbered(rows, ["f"], F.desc("o"), to="n")
    assert found.columns == ["f", "o", "n"]
    want, seen = {}, {}
    for o in range(4000, 0, -1):
        f = None if (4000 - o) % 50 == 0 else "hot"
        seen[f] = seen.get(f, 0) + 1
        want[f, o] = seen[f]
    assert {(r["f"], r["o"]): r["n"] for r in found.collect()} == want
    spread = rows.repartitionByRange("f", F.desc("o")).where("f = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 2500
    assert K.numbered(rows.limit(0), ["f"], "o").count() == 0


def test_sums_of_all_rows_before(spark, in_ranges):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    found = {r["id"]: r["b"] for r in K.running_before(rows, "v", "id", to="b").collect()}
    assert found == {i: sum(k % 7 for k in range(i)) for i in range(1000)}


def test_surrogates_and_chunks(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("a", 2)], "f string, o int")
    assert {(r["f"], r["o"]): r["number"] for r in K.assign_surrogate(rows, "f", 100, "o").collect()} == {("a", 1): 101, ("a", 2): 102, ("a", 3): 103, ("b", 9): 101}
    assert {(r["f"], r["o"]): r["chunk"] for r in K.chunk_queue(rows, 2, "f", "o").collect()} == {("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("b", 9): 0}


@pytest.mark.parametrize("times", [1, 10])
def test_a_common_token_makes_no_candidates(spark, times):
    """All titles share two words; a floor that these can't reach leaves each target its own titles, at ten times the rows too."""
    n = 30 * times
    targets = spark.range(n).select("id", F.concat(F.lit("card game w"), F.col("id").cast("string")).alias("name"), F.lit(" box").alias("suffix"))
    titles = spark.range(2 * n).select(F.col("id").alias("c"), F.concat(F.lit("game of card w"), (F.col("id") % n).cast("string"), F.when(F.col("id") < n, " box").otherwise("")).alias("title"))
    scored = X.scored_candidates(targets, titles, "id", "name", "c", "title", "suffix", floor=1.0)
    assert scored.count() == 2 * n
    best = X.best_candidates(targets, titles, "id", "name", "c", "title", "suffix")
    assert {(r["id"], r["c"], r["score"]) for r in best.collect()} == {(k, k, 1.25) for k in range(n)}
    other = spark.createDataFrame([(1, "card x y z", None), (2, "nothing", None)], "id long, name string, suffix string")
    assert [(r["id"], r["c"], r["score"]) for r in X.best_candidates(other, titles, "id", "name", "c", "title", "suffix").collect()] == [(1, 0, 0.25)]


def test_a_common_run_of_characters_makes_no_pairs(spark):
    long = spark.range(300).select(F.concat(F.lit("set of cards no"), F.col("id").cast("string"), F.lit("x")).alias("outer"))
    short = spark.createDataFrame([("set of cards no7x",), ("no29x",), ("cards",), ("zzz",)], "inner string")
    found = X._containing(short, "inner", long, "outer").groupBy("inner").count().collect()
    assert {r["inner"]: r["count"] for r in found} == {"set of cards no7x": 1, "no29x": 1, "cards": 300}


def test_ties_are_listed(spark):
    scored = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "b", 2.0), (1, "c", 1.7), (2, "a", 1.5), (3, "a", 1.4)], "t int, c string, s double")
    found = {r["t"]: (r["status"], r["c"], r["tied"]) for r in X.best_or_ambiguous(scored, "t", "c", "s").collect()}
    assert found == {1: ("ambiguous", None, ["a", "b"]), 2: ("hit", "a", None)}


def test_a_hot_partition_and_the_order_of_generations(spark, tmp_path):
    path = str(tmp_path / "cards")
    rows = [(1, "A VMAX", "en", 1), (1, "B VMAX", "en", 2), (2, "C VMAX", "en", 1), (2, "C", "en", 3), (3, "D VMAX", "ja", 1)] + [(k, "plain", "en", 1) for k in range(10, 200)]
    S.write_catalog(spark.createDataFrame(rows, "id long, name string, language string, generation int"), path)
    found = S.collect_by_pattern(spark, path, "en", "VMAX", ["id", "name"])
    assert {(r["id"], r["name"], r["generation"]) for r in found.collect()} == {(1, "A VMAX", 1), (1, "B VMAX", 2), (2, "C VMAX", 1)}
    assert {(r["id"], r["name"]) for r in S.id_index(found, "id").collect()} == {(1, "B VMAX"), (2, "C VMAX")}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(language" in plan
