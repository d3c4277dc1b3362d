"""What reviews of larger and odder tables have found."""

import pytest
from compare import same
from pyspark.sql import functions as F

from quarry.operators import jobs as J
from quarry.operators import match as X
from quarry.operators.collection import species_state
from quarry.plans.registry import ORACLES, QUERIES
from quarry.streaming.state import collection_sink
from quarry.streaming.store import Keyed, VersionedStore


@pytest.fixture
def held_against_sql(spark, tmp_path):
    """A query against its SQL on tables made for it."""
    import duckdb

    def check(name: str, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])

    return check


def test_pages_of_one_url_have_their_own_status(spark, held_against_sql):
    pages = spark.createDataFrame([(3, "http://a/1"), (4, "http://a/1"), (8, "http://b/2"), (9, "http://c/3")], "page_id long, url string")
    held_against_sql("t9_rewrite_mirrored_urls", pages=pages)
    done = spark.createDataFrame([("http://a/1", "done")], "url string, status string")
    assert J.rewrite_urls(pages, "url", done, F.lit("own")).where("rewritten").count() == 2


def test_references_without_a_semicolon_are_text(spark, held_against_sql):
    html = '<html><head><title>A &amp; b&amp</title></head><body><h1>x&ltd &lt;d&amp</h1><div class="ad">c &amp;amp; &quot</div><img src="p.jpg"></body></html>'
    held_against_sql("x4_extract_card_pages", pages=spark.createDataFrame([(1, html), (2, "<h1>a&b & c</h1>")], "page_id long, html string"))


def test_the_state_of_a_stream_needs_no_call_for_each_key(spark, tmp_path):
    """Batches go on from what the store holds; a replay changes nothing."""
    schema = "user long, seq long, action string, species long, card_id string"
    rows = [(u, s, ["own", "wish", "unown", "unwish", "wish"][(u * s + s // 7) % 5], s % 3, str(s % 4)) for s in range(60) for u in range(5)]
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    store = VersionedStore(spark, str(tmp_path / "out"), {"state": Keyed("user long, species long, owned string, wish string, seq long", ["user", "species"], ["seq"])}, buckets=2)
    want = {(r["user"], r["species"]): (r["owned"], r["wish"]) for r in species_state(spark.createDataFrame(rows, schema)).collect()}
    for checkpoint in ("a", "b"):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = collection_sink(stream, store, "state", str(tmp_path / checkpoint))
        query.awaitTermination(120)
        assert query.exception() is None and store.last() == 2
        held = store.read("state").collect()
        assert {(r["user"], r["species"]): (r["owned"], r["wish"]) for r in held} == want
        assert all(r["seq"] == max(s for u, s, _, p, _ in rows if (u, p) == (r["user"], r["species"])) for r in held)


def test_many_rows_of_one_place_meet_once(spark):
    """A thousand cards and a thousand source rows of one set and number: the joins make rows in proportion."""
    cards = spark.range(1000).select(F.col("id").alias("card_id"), F.lit("base").alias("set_key"), F.lit("1").alias("local_key"), F.lit("bolt").alias("name_key"), F.lit(7).alias("species"))
    source = spark.range(1000).select(F.col("id").alias("source_id"), F.lit("base").alias("set_key"), F.lit("1").alias("local_key"), F.when(F.col("id") == 5, "bolt ex").otherwise("gear").alias("name_key"), F.array(F.lit("x")).alias("species_keys"), F.array(F.lit(7)).alias("species"))
    for found, want in ((X.match_english(cards, source), ("primary", 5)), (X.match_japanese(cards, source), ("ambiguous", None))):
        assert {(r["kind"], r["source_id"]) for r in found.collect()} == {want} and found.count() == 1000
        assert _widest_join(found) < 100_000


def _widest_join(df) -> int:
    """The most rows that a join of the plan made."""
    import re

    df.write.format("noop").mode("overwrite").save()
    made = [0]

    def walk(node) -> None:
        if "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if re.search("Join", node.nodeName()) and node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    walk(plan)
    return max(made)


def test_candidates_of_one_title_meet_targets_once(spark, monkeypatch):
    """A thousand candidates of two titles: two rows are scored, and the first candidate of the best title is found."""
    met, scored = [], X.scored_candidates
    monkeypatch.setattr(X, "scored_candidates", lambda targets, candidates, *rest: met.append(candidates.count()) or scored(targets, candidates, *rest))
    targets = spark.range(20).select(F.col("id").alias("target"), F.lit("red bolt gear").alias("wanted"), F.lit("box").alias("suffix"))
    titles = spark.range(1000).select(F.col("id").alias("candidate"), F.when(F.col("id") % 3 == 2, "red bolt").otherwise("red").alias("title"))
    best = X.best_candidates(targets, titles, "target", "wanted", "candidate", "title", "suffix").collect()
    assert {r["target"] for r in best} == set(range(20)) and {(r["candidate"], round(r["score"], 6)) for r in best} == {(2, 0.666667)}
    assert max(met) == 2


@pytest.mark.parametrize("block", [1 << 15, 7])
def test_a_long_chain_of_conflicts_needs_no_round_each(spark, monkeypatch, block):
    """Two kinds whose cards alternate want the same rows, and one of them rows of its own: each conflict leads to the next."""
    monkeypatch.setattr(X, "BLOCK", block, raising=False)
    written, keep = [], X.keep
    monkeypatch.setattr(X, "keep", lambda df, name: written.append(name) or keep(df, name))
    cards = [(1, "ab"[k % 2], k) for k in range(40)] + [(2, "a", 5), (3, "c", 6), (None, "a", 7)]
    offers = [(1, kind, row, "exact" if kind == "b" and row % 5 == 0 else "prefix") for kind in "ab" for row in range(30)] + [(2, "a", 3, "exact"), (2, "a", 1, "prefix"), (None, "a", 2, "exact")]
    found = X.in_card_order(spark.createDataFrame(cards, "g int, kind string, card_pos long"), spark.createDataFrame(offers, "g int, kind string, row_pos long, how string"), ["g"], "kind")
    free, want = {(g, row) for g, _, row, _ in offers}, set()
    for g, kind, pos in sorted(cards, key=lambda c: c[2]):
        mine = sorted((how, row) for og, ok, row, how in offers if g is not None and (og, ok) == (g, kind) and (g, row) in free)
        if mine:
            free.remove((g, mine[0][1]))
            want.add((g, pos, mine[0][1], mine[0][0]))
    assert {(r["g"], r["card_pos"], r["row_pos"], r["how"]) for r in found.collect()} == want and found.count() == len(want)
    assert len(written) <= 3 + 2 * 40 // block
    nothing = X.in_card_order(spark.createDataFrame([], "g int, kind string, card_pos long"), spark.createDataFrame(offers, "g int, kind string, row_pos long, how string"), ["g"], "kind")
    assert nothing.collect() == []


def test_a_tree_of_records_is_written_and_listed_by_shelves(spark, held_against_sql, tmp_path, monkeypatch):
    """A record for each supplier: the tree's root has a folder for each shelf, each written by one task."""
    from quarry.plans import sources

    monkeypatch.setattr(sources, "scratch", lambda session, name: str(tmp_path / name))
    held_against_sql("s3_read_record_tree", supplier=spark.range(300).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier "), F.col("id").cast("string")).alias("s_name")))
    tree = tmp_path / "records"
    shelves = [p for p in tree.iterdir() if p.is_dir()]
    assert 32 < len(shelves) <= 128
    for shelf in shelves:
        tasks = {f.name.split("-")[1] for f in shelf.rglob("*.txt")}
        assert len(tasks) == 1
    assert len(list(tree.rglob("*.txt"))) == 300
