"""Near-dedup: SimHash fingerprints and pivot distance tables.

Texts become 64-bit fingerprints; equal fingerprints are folded into one row. To find fingerprints that differ in few
bits, each is described once by its Hamming distances to ``PIVOTS`` reference fingerprints (``distance_table``). Two
fingerprints within k bits differ by k or less in every such distance, so that a pair is discarded as soon as one
coordinate differs by more, and only the survivors' bits are compared.

Tables are kept small without loss: the bits are cut into ``blocks`` runs, and two fingerprints that differ in k bits
agree on all bits of some blocks - k of them. Each fingerprint, with its distances, enters one table for each choice of
those blocks, keyed by their bits, and pairs meet in the table that they share. Small tables are handled together; one of
more than ``TABLE_ROWS`` rows is cut into parts, and every pair of parts is a task of its own, so that a hot table
spreads over the cluster. A table sends on a forest of links, nearest pairs first: one less than there are rows, never
all pairs.

Words are runs without white space, A-Z in lower case; a shingle is ``width`` words joined by one space (five, unless
said otherwise), and a text of fewer words is one shingle. A bit is set when more than half of the shingles' XXH64
values (seed 42) have it. With a radius, fingerprints within that many bits are linked. Without one, texts of
``similarity`` (Jaccard of their shingles) or more are linked, see ``near_texts``.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows that repeat a doc_id
are returned one by one with the component of that id; a null doc_id gets a fingerprint and its component's id but
names none (null where all its members are null). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.graph import components
from quarry.llm.shared import keep

PIVOTS = 16
#: Rows of a table, or of a part of it, that one task compares.
TABLE_ROWS = 8192
#: Mean rows of a table that the number of blocks aims at, and tables that a fingerprint enters, at most.
_MEAN_ROWS, _TABLES = 128, 512


def shingle_values(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of each text, repeats included, and their bounds by text."""
    data, at = W.text_bytes(column)
    data = W.lower_table()[data]
    starts, ends, first_word = W.bounds(data, at, W.whitespace_table())
    # the words alone, each followed by one space
    size = ends - starts + 1
    place = np.cumsum(size)
    text = np.append(data, np.uint8(0x20))[np.minimum(W.ranges(starts, size), len(data))]
    text[place - 1] = 0x20
    starts, ends = place - size, place - 1
    n_words = np.diff(first_word)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = W.ranges(first_word[:-1], n)
    last = first + np.repeat(np.minimum(n_words, width), n) - 1
    return W.xxh64(text, starts[first], ends[last]), np.append(0, np.cumsum(n))


def votes(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints of texts from their shingles' values."""
    n = np.diff(edges)
    out = np.zeros(len(n), np.uint64)
    step = 1 << 16
    for low in range(0, len(n), 256):  # texts
        high = min(low + 256, len(n))
        counts = np.zeros((high - low, 64), np.int64)
        for a in range(edges[low], edges[high], step):
            b = min(a + step, edges[high])
            bits = np.unpackbits(values[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own = np.searchsorted(edges, np.arange(a, b), "right") - 1 - low
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            counts[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        over = (2 * counts > n[low:high, None]).astype(np.uint8)
        out[low:high] = np.packbits(over, axis=1).view(">u8").ravel()
    return out.view(np.int64)


def fingerprint_batch(column: pa.Array, width: int = 5) -> np.ndarray:
    """Signed 64-bit fingerprints of a column of texts."""
    return votes(*shingle_values(column, width))


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id`` and 64-bit ``fp`` of each row of ``docs`` (doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_batch(batch.column(1), width))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, spread over all bits."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_distances(fp: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """A row of Hamming distances to the pivots for each fingerprint."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ pivots(n)[None])


def distance_table(fps: DataFrame) -> DataFrame:
    """``fps`` (fp) with ``distances``: one byte for each pivot; written to the shared folder."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pivot_distances(batch.column(0).to_numpy())
            column = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["fp", "distances"])

    return keep(fps.select("fp").mapInArrow(measure, "fp long, distances binary"), "pivot-distances")


def blocks_for(n: int, radius: int) -> int:
    """Blocks that keep tables of ``n`` fingerprints small without too many tables."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > _MEAN_ROWS and comb(blocks + 1, radius) <= _TABLES:
        blocks += 1
    return blocks


def _links(radius: int):
    """Fingerprints of some tables (or of two parts of each) to a forest of links that joins all near ones."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fp = table.column("fp").to_numpy()
        distances = np.frombuffer(b"".join(table.column("distances").to_pylist()), np.uint8).reshape(len(fp), -1).astype(np.int16)
        bits = np.unique(table.column("bits").to_numpy(), return_inverse=True)[1]
        first = bits.astype(np.int64) << 8 | distances[:, 0]
        order = np.argsort(first, kind="stable")
        fp, distances, first = fp[order], distances[order], first[order]
        part = table.column("part").to_numpy()[order]
        # from each row to the end of those in its table whose first coordinate is near enough
        reach = np.searchsorted(first, first + radius, "right")
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        root = np.arange(len(fp))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        merged: list[tuple[int, int]] = []
        step = max(1, (1 << 21) // max(1, len(fp)))
        for low in range(0, len(fp), step):
            high = min(low + step, len(fp))
            n = reach[low:high] - np.arange(low, high) - 1
            a = np.repeat(np.arange(low, high), n)
            b = W.ranges(np.arange(low, high) + 1, n)
            if across:
                a, b = (x[part[a] != part[b]] for x in (a, b))
            for k in range(1, distances.shape[1]):
                near = np.abs(distances[a, k] - distances[b, k]) <= radius
                a, b = a[near], b[near]
            differ = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64))
            near = np.flatnonzero(differ <= radius)
            if not len(near):
                continue
            top = root  # pairs that earlier rows have joined already are left out
            while not np.array_equal(up := top[top], top):
                top = up
            near = near[top[a[near]] != top[b[near]]]
            near = near[np.argsort(differ[near], kind="stable")]  # nearest first
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    merged.append((i, j))
        ends = np.array(merged, np.int64).reshape(-1, 2)
        return pa.table({"a": fp[ends[:, 0]], "b": fp[ends[:, 1]]})

    return links


def _keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key for each choice of ``blocks - radius`` blocks: the choice's number and the bits of those blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    mask = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    found = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bits = np.uint64(sum(mask[k] for k in chosen)).view(np.int64)
        found.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(int(bits))).alias("bits")))
    return F.explode(F.array(*found))


def in_parts(rows: DataFrame, parts: Column, key: Column) -> DataFrame:
    """Each row once for every pair of parts (low, high) that its own part takes part in."""
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("parts", "other")


def near_links(fps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``fps`` (fp) that join all those within ``radius`` bits."""
    if not 0 < radius < 32:
        raise ValueError("radius: 1 to 31 bits")
    described = distance_table(fps)
    n = described.count()
    blocks = blocks or blocks_for(n, radius)
    keyed = described.select("fp", "distances", _keys(F.col("fp"), blocks, radius).alias("key")).select("fp", "distances", "key.*")
    hot = keep(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > TABLE_ROWS), "hot-tables")
    if hot.isEmpty():
        met = keyed.withColumns({"part": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    else:
        met = in_parts(keyed.join(hot, ["choice", "bits"], "left"), F.coalesce(F.ceil(F.col("n") / TABLE_ROWS), F.lit(1)).cast("int"), F.col("fp"))
    bundle = F.pmod(F.xxhash64("bits"), F.lit(max(1, n // TABLE_ROWS)))
    met = met.select("choice", bundle.alias("bundle"), "low", "high", "bits", "fp", "part", "distances")
    return met.groupBy("choice", "bundle", "low", "high").applyInArrow(_links(radius), "a long, b long")


def near_fingerprints(docs: DataFrame, radius: int = 4, width: int = 5) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its class: doc_id, fp, component_id.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest doc_id reachable, itself included.
    """
    rows = keep(fingerprints(docs, width), "fingerprints")
    distinct = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = near_links(distinct.select("fp"), radius)
    classes = components(links, "components").withColumnRenamed("node", "fp")
    members = distinct.join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(members.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
