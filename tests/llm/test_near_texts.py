"""Near-dedup by similarity against brute force over all pairs of texts, whatever the bits of their fingerprints."""

import random
import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import unquote

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import fingerprint, lower, split

from quarry.llm import graph, near_texts, shared, simhash

DATA = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = split(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def by_brute_force(rows):
    """The smallest doc_id of each row's class, by all pairs of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr), len({find(i) for i in range(len(rows))})


def found(df):
    return sorted(((r["doc_id"], r["component_id"]) for r in near_texts.near_duplicates(df).collect()), key=repr)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("small", "table", "often"), [(64, 8192, 4), (2, 8192, 2), (2, 4, 10**9)])
def test_all_alike_texts_meet(docs, monkeypatch, small, table, often):
    for module, name, value in ((near_texts, "SMALL", small), (simhash, "TABLE_ROWS", table), (near_texts, "OFTEN", often), (near_texts, "BUNDLE_ROWS", 2000)):
        monkeypatch.setattr(module, name, value)  # groups that wait, groups in parts, no common shingles
    rows = texts(docs)
    fps = {d: fingerprint(t, 5) for d, t in rows}
    want = by_brute_force(rows)[0]
    got = dict(found(docs))
    assert sorted(got.items(), key=repr) == want
    # alike, though seventeen and eleven bits differ
    assert (fps[177] ^ fps[1]).bit_count() == 17 and got[177] == got[1]
    assert (fps[145] ^ fps[6]).bit_count() == 11 and got[145] == got[6]


def variants(n, seed, changes):
    """Texts of 120 words from a few that many share, and copies of each with some words changed at random."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    rows = []
    for _ in range(n // 40):
        base = [word() for _ in range(120)]
        for _ in range(40):
            own = list(base)
            for _ in range(draw.randrange(changes)):
                own[draw.randrange(120)] = word()
            rows.append((len(rows), " ".join(own)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("small", "table"), [(64, 8192), (3, 8192), (3, 7)])
def test_groups_of_copies_near_the_edge(spark, monkeypatch, small, table):
    for module, name, value in ((near_texts, "SMALL", small), (simhash, "TABLE_ROWS", table), (near_texts, "RADIUS", 1)):
        monkeypatch.setattr(module, name, value)
    rows = variants(160, 5, 9)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == by_brute_force(rows)[0]


def test_near_dedup_stage(spark, docs):
    stay = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, DATA)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted({c for _, c in by_brute_force(texts(docs))[0]})


def test_edge_of_the_similarity(spark):
    words = [f"w{i}" for i in range(40)]
    # 36 shingles; k words replaced at the end leave 36 - k of 36 + k
    rows = [(10, " ".join(words)), (11, " ".join(words[:36] + list("abcd"))), (12, " ".join(words[:35] + list("vwxyz"))), (13, "a b"), (14, "A  b"), (15, "a"), (16, ""), (17, None), (18, " \t")]
    got = dict(found(spark.createDataFrame(rows, "doc_id long, text string")))
    a, b, c = (shingles(t) for _, t in rows[:3])
    assert alike(a, b) and not alike(a, c)
    assert got == {10: 10, 11: 10, 12: got[12], 13: 13, 14: 13, 15: 15, 16: 16, 17: 16, 18: 16}
    assert sorted(got.items()) == by_brute_force(rows)[0]


def test_odd(spark, odd, empty):
    rows = texts(odd)
    want, classes = by_brute_force(rows)
    assert found(odd) == want
    stay = near_texts.first_of_each(odd)
    assert stay.columns == odd.columns and stay.count() == classes
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 2, 4, 5, 7]  # the row without a doc_id is a copy of 1
    assert near_texts.near_duplicates(empty).count() == 0 and near_texts.first_of_each(empty).count() == 0
    # a class without doc_ids keeps one row; of repeated rows one stays, the same in any order
    lost = spark.createDataFrame([(None, "one two three", "a"), (None, "one two three", "b"), (3, "four", "x"), (3, "four", "y")], "doc_id long, text string, node string")
    kept = [sorted(map(tuple, near_texts.first_of_each(x).collect()), key=repr) for x in (lost, lost.orderBy(F.desc("node")))]
    assert kept[0] == kept[1] and [r[:2] for r in kept[0]] == [(3, "four"), (None, "one two three")]


def peak_mb(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_holds_a_few_mb():
    """At 0.5 GB two tasks of an executor, which held 150 to 300 MB each, passed its limit."""
    draw = np.random.default_rng(3)
    words = np.array([f"w{i:05}" for i in range(20000)])
    texts = [" ".join(draw.choice(words, 600)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(np.arange(2000)), pa.array(texts)], names=["doc_id", "node", "text"])
    none = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    rows = own = 0

    def send():
        nonlocal rows, own
        for sent in near_texts._send(5, 0.8, 7, none)(iter([batch])):
            rows += sum(len(x.as_py()) // 40 for x in sent.column("postings") if x.is_valid)
            own += sent.num_rows - sent.column("node").null_count

    peak = peak_mb(send)[1]
    assert own == 2000 and rows == 2000 * (596 - 477 + 1)  # a fifth of the shingles of each text, and one
    assert peak < 60
    # 4.5 million pairs of a group: of each text the nearest later one
    n = 3000
    column = [np.zeros(n, np.int64), np.arange(n), draw.integers(0, 1 << 62, n), np.full(n, 600), np.zeros(n, np.int64)]
    (pairs, more), peak = peak_mb(lambda: near_texts._offers(*column, 0.8, n, 1))
    differ = np.bitwise_count(column[2][:, None] ^ column[2][None]).astype(np.int64) + 100 * np.tri(n, dtype=np.int64)
    assert pairs.tolist() == [[i, j] for i, j in enumerate(differ.argmin(axis=1)[:-1].tolist())] and more.all()
    assert peak < 40


def test_few_documents_are_handed_over_at_once(spark, docs, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, keep = spark.conf.get(name), near_texts.keep
    monkeypatch.setattr(near_texts, "keep", lambda df, at: seen.append((at, int(spark.conf.get(name)))) or keep(df, at))
    near_texts.text_classes(docs)
    assert {"meetings", "screened", "verified"} <= {at for at, _ in seen} and all(n <= 1000 for _, n in seen)
    assert spark.conf.get(name) == before


def test_freed_tables_take_no_job(spark):
    """each freed table was a job of the driver, about a quarter of near-dedup's statements."""
    kept = shared.keep(spark.range(9), "freed")
    folder = Path(unquote(kept.inputFiles()[0]).removeprefix("file:")).parent
    assert folder.exists()
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("freed"))
    spark.sparkContext.setJobGroup("freed", "")
    try:
        assert kept.count() == 9 and (before := jobs())
        shared.discard(kept)
        shared.discard(kept)  # nothing is there any more
        assert jobs() == before and not folder.exists()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stars_take_no_round_of_components(spark, monkeypatch):
    """two counts of links a round, and one round more to see that nothing changes."""
    kept, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, name: kept.append(name) or keep(df, name))

    def rounds(edges):
        kept.clear()
        return {(r["node"], r["component"]) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}, len(kept) - 1

    assert rounds([(1, 0), (0, 2), (3, 0), (8, 7), (7, 8), (9, 9), (None, 1)]) == ({(n, 0) for n in range(4)} | {(7, 7), (8, 7)}, 0)
    assert rounds([(2, 1), (2, 0)]) == ({(0, 0), (1, 0), (2, 0)}, 1)
    assert rounds([(2, 1), (1, 0)]) == ({(0, 0), (1, 0), (2, 0)}, 1)
    assert rounds([]) == (set(), 0)
    chain, n = rounds([(i, i + 1) for i in range(50)] + [(100, 101)])
    assert chain == {(i, 0) for i in range(51)} | {(100, 100), (101, 100)} and n > 1


def test_later_rounds_start_from_the_classes(spark, monkeypatch):
    """components of all links were found anew in each round; now classes and new links are joined."""
    for name, value in (("SMALL", 3), ("RADIUS", 1)):
        monkeypatch.setattr(near_texts, name, value)
    seen, components = [], near_texts.components

    def watched(edges, name):
        found = components(edges, name)
        seen.append(({tuple(sorted(r)) for r in edges.collect()}, {(r["component"], r["node"]) for r in found.collect()}))
        return found

    monkeypatch.setattr(near_texts, "components", watched)
    rows = variants(160, 5, 12)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == by_brute_force(rows)[0]
    rounds = list(zip(seen, seen[1:], strict=False))
    assert all(classes <= edges for (_, classes), (edges, _) in rounds)
    assert any(before - classes for (before, classes), _ in rounds)
    assert not any((before - classes) & edges for (before, classes), (edges, _) in rounds)


def test_texts_of_few_pairs_alone_are_sent(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "node long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 4)], "a long, b long")
    assert sorted(r["node"] for r in near_texts._of_pairs(texts, pairs).collect()) == [1, 2, 4]
    monkeypatch.setattr(near_texts, "BROADCAST_NODES", 3)
    assert near_texts._of_pairs(texts, pairs).count() == 6


def test_later_rounds_send_the_texts_of_their_pairs(spark, docs, monkeypatch):
    sent, verified = [], near_texts.verified

    def counted(pairs, texts, width, similarity):
        sent.append((texts.count(), 2 * pairs.count()))
        return verified(pairs, texts, width, similarity)

    monkeypatch.setattr(near_texts, "verified", counted)
    monkeypatch.setattr(near_texts, "SMALL", 2)
    near_texts.text_classes(docs)
    assert len(sent) > 1 and all(n <= most for n, most in sent[1:])


def test_free_memory_goes_back():
    def held():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    arrays = [np.ones(4000) for _ in range(6000)]
    some = arrays[::60]  # between the others, which keeps an allocator from giving them back by itself
    del arrays
    before = held()
    shared.give_back()
    assert len(some) == 100 and held() < before - 100
