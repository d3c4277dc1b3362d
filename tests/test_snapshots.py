"""Publishing that breaks off, and views of which fresh parts stay as they are."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import extract as E
from quarry.sources import snapshots as N
from quarry.sources.folders import children


def rows(spark, n, start=0):
    return spark.range(start, start + n).select("id", (F.col("id") % 3).alias("g"))


def test_publish(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        N.read_snapshot(spark, path)
    first = N.publish(rows(spark, 9), path, "g", F.when(F.col("id") == 4, "bad"), F.col("id") == 5)
    assert N.published(spark, path) == [first] and N.read_snapshot(spark, path).columns == ["id", "g"]
    assert {r["id"] for r in N.read_snapshot(spark, path).collect()} == {0, 1, 2, 3, 6, 7, 8}
    assert [tuple(r) for r in N.read_snapshot(spark, path, "failures").collect()] == [(4, 1, "bad")] and N.read_snapshot(spark, path, "skipped").first()["id"] == 5
    assert {tuple(r) for r in N.read_snapshot(spark, path, "manifest").select("g", "records", "failures", "skipped").collect()} == {(0, 3, 0, 0), (1, 2, 1, 0), (2, 2, 0, 1)}
    second = N.publish(rows(spark, 3), path, "g", snapshot="second")
    assert N.published(spark, path) == [first, second] and N.read_snapshot(spark, path).count() == 3 and N.read_snapshot(spark, path, snapshot=first).count() == 7
    with pytest.raises(FileExistsError):
        N.publish(rows(spark, 3), path, "g", snapshot="second")
    N.publish(rows(spark, 4), path, "g", snapshot="third")
    assert N.retire(spark, path, 1) == [first, second] and N.published(spark, path) == ["third"] and N.read_snapshot(spark, path).count() == 4
    assert N.publish(rows(spark, 5), path, "g", snapshot="fourth") == "fourth" and N.published(spark, path) == ["third", "fourth"]


@pytest.mark.parametrize("step", ["rows", "manifest", "counts", "move", "nothing"])
def test_a_publish_that_breaks_off(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path)
    N.publish(rows(spark, 9), path, "g", snapshot="old")
    df = rows(spark, 5)
    if step == "rows":
        df = df.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")))
    elif step == "nothing":
        df = df.limit(0)
    elif step == "move":
        monkeypatch.setattr(N, "_move", lambda *_: (_ for _ in ()).throw(OSError("broken")))
    elif step == "counts":
        df = df.withColumn("id", F.when(F.rand() < 2, F.col("id")))
        monkeypatch.setattr(N.Observation, "get", property(lambda self: {"rows": 6, "failures": 0}))
    with pytest.raises(Exception, match=r"broken|were written|nothing to publish|g2"):
        N.publish(df, path, "g2" if step == "manifest" else "g", snapshot="new")
    assert N.published(spark, path) == ["old"] and N.read_snapshot(spark, path).count() == 9
    assert set(children(spark, f"{path}/snapshots")) == {"old"} and not children(spark, f"{path}/staging")


def test_only_stale_parts_are_computed(spark, tmp_path):
    path, asked = str(tmp_path / "view"), []
    stamps = N.stamps_store(spark, str(tmp_path / "stamps"))
    df = rows(spark, 30).withColumn("g", F.concat(F.lit("part "), F.col("g").cast("string")))

    def compute(gone=()):
        def run(keys):
            asked.append({r[0] for r in keys.collect()})
            return df.where(~F.col("g").isin(*gone)).join(keys, "g", "left_semi").withColumn("n", F.lit(len(asked)))

        return run

    files = lambda: {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "view").rglob("*.parquet")}
    N.refresh_view(df, "g", 1, path, stamps, compute())
    before = files()
    assert N.refresh_view(df, "g", 1, path, stamps, compute()).isEmpty() and files() == before
    stamps.commit(50, {"stamps": spark.createDataFrame([("part 0", 2), ("part 2", 2)], "part string, version long")})
    N.refresh_view(df, "g", 2, path, stamps, compute())
    assert asked[-1] == {"part 1"} and {r["n"] for r in spark.read.parquet(path).where("g = 'part 1'").select("n").collect()} == {3}
    same = {f: t for f, t in files().items() if "part 1" not in str(f)}
    assert same == {f: t for f, t in before.items() if "part 1" not in str(f)}
    stamps.commit(60, {"stamps": spark.createDataFrame([("part 1", 9)], "part string, version long")})
    N.refresh_view(df, "g", 2, path, stamps, compute(["part 1"]))
    assert spark.read.parquet(path).where("g = 'part 1'").isEmpty() and spark.read.parquet(path).count() == 20


def test_fields_hold_inner_elements_of_their_tag(spark):
    html = '<div class="ad">one <div>two</div> three</div><div>four</div><h1>a<b>b</b></h1><p>open <div class="ad">no</div>'
    page = spark.createDataFrame([(1, html), (2, None), (3, '<div class="ad x">')], "id int, html string")
    found = E.card_pages(page, "html", {"ad": ("div", "ad"), "head": ("h1", None), "par": ("p", None)}, ["id"]).orderBy("id").collect()
    assert [tuple(r)[:4] for r in found] == [(1, "one two three", "ab", "open no"), (2, None, None, None), (3, "", None, None)]
