"""Commits of the versioned store, harvest runs and stages, with what breaks off and what comes twice."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import harvest as H
from quarry.operators.stages import counts_by_method, resolve_in_stages
from quarry.sources.folders import children
from quarry.streaming.store import Keyed, VersionedStore

TABLES = {"a": Keyed("k long, v string, n long", ["k"], ["n"]), "b": Keyed("x string, y long", ["x"])}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def rows(spark, values, schema="k long, v string, n long"):
    return spark.createDataFrame(values, schema)


def files_of(spark, path):
    return {name for batch in children(spark, path).values() for name in children(spark, batch)}


def test_commits(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), TABLES, buckets=4)
    assert store.last() is None and store.read("a").count() == 0
    assert store.commit(3, {"a": rows(spark, [(k, "old", 1) for k in range(40)]), "b": rows(spark, [("p", 1), ("q", 2)], "x string, y long")})
    assert not store.commit(3, {"a": rows(spark, [(1, "twice", 9)])}) and not store.commit(2, {"a": rows(spark, [(1, "late", 9)])})
    assert store.read("a").where("v <> 'old'").count() == 0
    change = rows(spark, [(5, "older", 0), (6, "newer", 2), (6, "newest", 3), (99, "first", 1)])
    assert store.commit(4, {"a": change, "b": rows(spark, [("p", None, True)], "x string, y long, gone boolean")})
    found = {r["k"]: r["v"] for r in store.read("a").collect()}
    assert found == {**dict.fromkeys(range(40), "old"), 6: "newest", 99: "first"} and rows_of(store.read("b")) == [("q", 2)]
    assert store.commit(9, {"b": rows(spark, [("q", None, True)], "x string, y long, gone boolean")})
    assert store.read("b").count() == 0 and store.read("a").count() == 41 and store.last() == 9


def test_only_touched_buckets_are_written_and_old_ones_go(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), TABLES, buckets=16)
    store.commit(0, {"a": rows(spark, [(k, "x" * 50, 0) for k in range(2000)])})
    size = lambda n: sum(f.stat().st_size for f in (tmp_path / f"a/batch={n}").rglob("*.parquet"))
    for n in range(1, 6):
        store.commit(n, {"a": rows(spark, [(7, f"v{n}", n)])})
        assert len(children(spark, str(tmp_path / f"a/batch={n}")).keys() - {"_SUCCESS"}) == 1 and size(n) < size(0) / 8
    assert store.read("a").where("k = 7").first()["v"] == "v5" and store.read("a").count() == 2000
    left = [n for n in range(1, 6) if size(n)]
    assert left == [4, 5]  # the last two versions of the bucket


def test_a_commit_that_breaks_off_is_not_seen(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), TABLES, buckets=2)
    store.commit(1, {"a": rows(spark, [(1, "one", 1)])})
    broken = rows(spark, [(1, "two", 2)]).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit(2, {"a": rows(spark, [(1, "two", 2)]), "b": rows(spark, [("z", 1)], "x string, y long").withColumn("x", F.raise_error(F.lit("broken")).cast("string"))})
    with pytest.raises(Exception, match="broken"):
        store.commit(2, {"a": broken})
    assert store.last() == 1 and rows_of(store.read("a")) == [(1, "one", 1)] and store.read("b").count() == 0
    assert store.commit(2, {"a": rows(spark, [(1, "three", 3)])}) and rows_of(store.read("a")) == [(1, "three", 3)]


@pytest.fixture
def harvest(spark, tmp_path):
    text = "{{l/entry|1|[[Big Bolt (Set 1)]]|x|Rare|}}\n{{l/entry|2|[[Nut (Set 2)]]|x|Rare|}}"
    pages = spark.createDataFrame([("One (TCG)", text), ("Two and Three (TCG)", text + "\n{{l/entry|3|[[Bolt (Set 3)]]|x||}}"), ("Void (TCG)", "no rows"), ("Null (TCG)", None)], "title string, wikitext string")
    species = spark.createDataFrame([("bolt", 1), ("Big Bolt", 2)], "name string, pos long")
    overrides = spark.createDataFrame([("e", "One (TCG)"), ("f", "Nowhere")], "job string, title string")
    return H.open_store(spark, str(tmp_path / "store"), 2), pages, species, overrides


def jobs_of(spark, *names):
    titles = {"a": "One (TCG)", "b": "Two & Three (TCG)", "c": "Void (TCG)", "d": "Null (TCG)", "e": "Else (TCG)", "f": "Gone (TCG)"}
    return spark.createDataFrame([(n, titles[n]) for n in names], "job string, title string")


def state(spark, store):
    return {r["job"]: (r["status"], r["method"], r["n_rows"], r["n_matched"], r["reason"], r["runs"]) for r in H.states(jobs_of(spark, *"abcdef"), store).collect()}


def test_harvest_and_retry(spark, harvest):
    store, pages, species, overrides = harvest
    direct = H.retry_stages(pages, overrides)[:1]
    assert H.run(store, 1, jobs_of(spark, *"abcde"), pages, direct, species)
    first = state(spark, store)
    assert first["a"] == ("done", "direct", 2, 1, None, None) and first["b"][0] == "failed" and first["c"] == ("done", "direct", 0, 0, None, None)
    assert first["d"][4] == "no text" and first["e"][4] == "no article" and first["f"][0] == "pending"
    assert not H.run(store, 1, jobs_of(spark, "f"), pages, direct, species) and state(spark, store) == first
    assert H.retry(store, 2, jobs_of(spark, *"abdef"), pages, overrides, species)  # c is listed no more
    after = state(spark, store)
    assert after["b"] == ("done", "variant", 3, 2, None, None) and after["e"] == ("done", "override", 2, 1, None, None)
    assert after["d"] == ("failed", None, None, None, "no text", 2) and after["c"] == first["c"] and after["f"] == first["f"]
    held = {r["job"]: [x["species"] for x in r["rows"]] for r in store.read("results").collect()}
    assert held == {"a": ["Big Bolt", None], "b": ["Big Bolt", None, "bolt"], "c": [], "e": ["Big Bolt", None]}
    assert H.run(store, 3, jobs_of(spark, *"abcdef").limit(0), pages, direct, species) and state(spark, store) == after


def test_stages_see_their_residue_alone(spark):
    seen = []

    def stage(*ids):
        def find(rest):
            seen.append(sorted(r["id"] for r in rest.collect()))
            return rest.where(F.col("id").isin(*ids)).select("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("found")).unionByName(rest.where("id = 4").select("id", F.lit(None).cast("string").alias("found")))

        return find

    out = resolve_in_stages(spark.range(6), [("x", stage(1, 2)), ("y", stage(2, 3)), ("z", stage(1, 3, 5))], "id")
    assert seen == [[0, 1, 2, 3, 4, 5], [0, 3, 4, 5], [0, 4, 5]]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(0, None, None), (1, "f1", "x"), (2, "f2", "x"), (3, "f3", "y"), (4, None, None), (5, "f5", "z")]
    assert {r["method"]: r["n"] for r in counts_by_method(out).collect()} == {"x": 2, "y": 1, "z": 1, "none": 2}


def test_articles_are_parsed_once(spark, harvest, monkeypatch):
    store, pages, species, overrides = harvest
    seen, parse = spark.sparkContext.accumulator(0), H.setlist_rows

    def noted(df):
        def note(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        out = parse(df)
        return out.mapInArrow(note, out.schema)

    monkeypatch.setattr(H, "setlist_rows", noted)
    assert H.run(store, 1, jobs_of(spark, "a", "c"), pages, H.retry_stages(pages, overrides)[:1], species)
    assert state(spark, store)["a"] == ("done", "direct", 2, 1, None, None)
    assert seen.value == 2
