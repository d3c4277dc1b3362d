"""Streaming forms of the state operators: ownership state, latest row per key, and windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quarry.operators.collection import species_state
from quarry.operators.keyed import latest_wins
from quarry.streaming.store import VersionedStore

#: The state store that ``collection_stream`` needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def next_state(owned: str | None, wish: str | None, action: str, card: str | None) -> tuple[str | None, str | None]:
    """What is owned and wished after an event; see ``quarry.operators.collection``."""
    if action == "own":
        return card, None
    if action == "unown":
        return None, wish
    if action == "unwish":
        return owned, None
    if action == "wish":
        return owned, card if wish is None else None if wish == card else wish
    return owned, wish


class _Collection(StatefulProcessor):
    """Owned and wished card of a (user, species), and the last seq that they hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "owned string, wish string, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        owned, wish, seq = self._state.get() if self._state.exists() else (None, None, None)
        events = pd.concat(list(rows))
        events = events.sort_values(["seq", "action", "card_id"], kind="stable").astype(object).where(events.notna(), None)
        for action, card in zip(events["action"], events["card_id"], strict=True):
            owned, wish = next_state(owned, wish, action, card)
        seq = max(int(events["seq"].max()), seq if seq is not None else -1)
        self._state.update((owned, wish, seq))
        yield pd.DataFrame([(*key, owned, wish, seq)], columns=["user", "species", "owned", "wish", "seq"])

    def close(self) -> None:
        pass


def collection_stream(events: DataFrame) -> DataFrame:
    """Changes of the collection state from a stream of events (user, seq, action, species, card_id).

    The state of a (user, species) is its owned and wished card. Events of a micro-batch are folded in order of seq; one
    row tells the state after it: user, species, owned, wish, seq. Events of an earlier batch with a larger seq aren't
    redone. The session must use ``ROCKS``.
    """
    return events.groupBy("user", "species").transformWithStateInPandas(_Collection(), "user long, species long, owned string, wish string, seq long", "Update", "None")


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by window and kind; those later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"))


def latest_sink(stream: DataFrame, store: VersionedStore, table: str, checkpoint: str, version: Sequence[str] | None = None) -> StreamingQuery:
    """Keeps the latest row of each key in a table of a store; every micro-batch is one commit that rewrites the buckets it touches."""
    keyed = store.tables[table]

    def write(batch: DataFrame, number: int) -> None:
        store.commit(number, {table: latest_wins(batch, keyed.keys, list(version or keyed.version))})

    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collection_sink(events: DataFrame, store: VersionedStore, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the collection state (user, species, owned, wish, seq) in a table of a store, as ``collection_stream`` tells it.

    A micro-batch is folded by ``species_state`` on from what the store holds, and is one commit; no call for each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = store.last()
        if last is not None and number <= last:  # a replayed batch: its events are in the state already
            return
        held = store.read(table)
        seqs = batch.groupBy("user", "species").agg(F.max("seq").alias("seq"))
        seqs = seqs.unionByName(held.select("user", "species", "seq").join(seqs, ["user", "species"], "left_semi")).groupBy("user", "species").agg(F.max("seq").alias("seq"))
        store.commit(number, {table: species_state(batch, held).join(seqs, ["user", "species"])})

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
