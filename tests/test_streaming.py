"""Streams against the batch forms of the same operators."""

from pyspark.sql import functions as F

from quarry.operators.collection import collection_state
from quarry.operators.keyed import latest_wins
from quarry.streaming.state import ROCKS, collection_stream, latest_sink, windowed_counts
from quarry.streaming.store import Keyed, VersionedStore

SCHEMA = "user long, seq long, action string, species long, card_id string"


def _files(spark, tmp_path):
    rows = [(u, s, ["own", "wish", "unown", "unwish", "wish"][(u + s) % 5], s % 3, str(s % 4)) for s in range(60) for u in range(3)]
    for k in range(3):
        spark.createDataFrame(rows[k * 60 : k * 60 + 60], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return spark.createDataFrame(rows, SCHEMA), spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_state_follows_the_batch_fold(spark, tmp_path):
    batch, stream = _files(spark, tmp_path)
    spark.conf.set(*ROCKS)
    query = collection_stream(stream).writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    spark.conf.unset(ROCKS[0])
    assert query.exception() is None
    seen = {}
    for r in spark.table("changes").collect():  # rows of a key come in order of their batches
        seen[r["user"], r["species"]] = (r["owned"], r["wish"])
    want = {}
    for r in collection_state(batch).collect():
        want.setdefault((r["user"], r["species"]), {})[r["kind"]] = r["card_id"]
    assert {k: v for k, v in seen.items() if v != (None, None)} == {k: (v.get("owned"), v.get("wish")) for k, v in want.items()}


def test_latest_rows_of_a_stream(spark, tmp_path):
    batch, stream = _files(spark, tmp_path)
    store = VersionedStore(spark, str(tmp_path / "out"), {"last": Keyed(SCHEMA, ["user"], ["seq"])}, buckets=2)
    for checkpoint in ("d", "e"):  # the second time all batches are there already
        query = latest_sink(stream, store, "last", str(tmp_path / checkpoint))
        query.awaitTermination(120)
        assert query.exception() is None and store.last() == 2
    assert sorted(map(tuple, store.read("last").select("user", "seq").collect())) == sorted(map(tuple, latest_wins(batch, ["user"], ["seq"]).select("user", "seq").collect()))


def test_windows_close_by_watermark(spark, tmp_path):
    rows = spark.range(600).select((F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, id * 60)")).alias("ts"), F.lit("view").alias("kind"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "f")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["n"] for r in spark.table("windows").collect()} == {60}
