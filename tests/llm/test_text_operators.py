"""Operators on texts against plain Python, and their edge cases."""

import hashlib
import re
import tracemalloc
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import decontamination, queries, sharding, simhash, substring_dedup
from quarry.llm import words as W

lower = lambda text: re.sub("[A-Z]", lambda m: m[0].lower(), text)
split = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")
DATA = "/root/testdata/sf0.001"


def without_repeats(rows, window=13):
    """Kept words by (doc_id, text) in plain Python."""
    first = {}
    for doc, text in rows:
        if doc is not None:
            w = split(text)
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_mb", [0.05, 8])
def test_substring_dedup(docs, block_mb):
    found = substring_dedup.remove_duplicates(docs, block_mb=block_mb)
    assert sorted(map(tuple, found.collect()), key=repr) == without_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_substring_dedup_odd(odd, empty):
    found = substring_dedup.remove_duplicates(odd)
    assert sorted(map(tuple, found.collect()), key=repr) == without_repeats([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert substring_dedup.remove_duplicates(empty).count() == 0


@pytest.mark.parametrize("order", ["doc_id", "-doc_id", "hash(text)"])
def test_windows_remembered_from_slab_to_slab(docs, odd, order):
    for table in (docs, odd.select("doc_id", "text")):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        one = table.coalesce(1).sortWithinPartitions(F.expr(order))
        found = substring_dedup.remove_duplicates(one, block_mb=0.5, slab_mb=0.004)
        assert sorted(map(tuple, found.collect()), key=repr) == without_repeats(rows)


def test_room_for_remembered_windows_does_not_matter(monkeypatch):
    hot = " ".join(f"w{i}" for i in range(60))
    rows = pa.record_batch({"doc_id": pa.array(range(400)), "tag": pa.array([0] * 400, pa.int16()), "text": [f"{hot} own{i // 100} {hot}" for i in range(400)]})

    def sent_and_found(limit):
        monkeypatch.setattr(substring_dedup._Shared.__init__, "__defaults__", (limit,))
        sent = list(substring_dedup._send(13, 4, 4000, np.int16)(iter([rows])))
        pieces = sum(len(b.column("seeds").drop_null()) for b in sent)
        spans = [s for t in pa.Table.from_batches(sent).group_by("block").aggregate([]).column("block").to_pylist() for s in substring_dedup._parse(13, np.int16)(pa.Table.from_batches(sent).filter(pa.compute.field("block") == t)).to_pylist()]
        gone = {(s["doc_id"], k) for s in spans for k in range(s["start"], s["start"] + s["n_words"])}
        return pieces, gone

    none, some, all_ = (sent_and_found(limit) for limit in (0, 20, 1 << 19))
    assert none[1] == some[1] == all_[1] and len(none[1]) > 399 * 100
    assert all_[0] < none[0] / 3


def test_factors_point_to_equal_words(docs):
    texts = {r["doc_id"]: split(r["text"]) for r in docs.collect()}
    spans = substring_dedup.duplicate_spans(docs, block_mb=0.05).collect()
    assert spans
    for s in spans:
        assert s["n_words"] >= 13 and s["ref_doc_id"] < s["doc_id"]
        assert texts[s["doc_id"]][s["start"] : s["start"] + s["n_words"]] == texts[s["ref_doc_id"]][s["ref_start"] : s["ref_start"] + s["n_words"]]


def test_passage_over_a_factor_boundary(spark):
    a = [f"a{i}" for i in range(40)]
    b = [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:20] + b[:20])), (3, " ".join(a[5:20] + b[:18]))]
    found = substring_dedup.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == without_repeats(rows)


def hits(rows, items, window=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {}
    for i, text in items:
        w = rx.findall(lower(text or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for doc, text in rows:
        w = rx.findall(lower(text or ""))
        hit, ids = [False] * len(w), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit[i : i + n] = [True] * n
                    ids |= phrases[tuple(w[i : i + n])]
        out.append((doc, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


def digest(found):
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long"), F.sha2(F.concat_ws(",", items), 256), F.col("n_hit") > 0)


@pytest.mark.parametrize("most", [10**6, 300])
def test_decontamination(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_PHRASES", most)  # several passes
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = digest(decontamination.decontaminate(docs, items))
    assert sorted(map(tuple, found.collect()), key=repr) == hits([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([("b", "QUICK brown fox jumps"), ("a", None), ("c", ""), ("d", "fox-jumps over the lazy dog again and again until it is"), ("b", "QUICK brown fox jumps"), ("e", "word"), ("f", "日本語 the")], "item_id string, text string")
    found = digest(decontamination.decontaminate(odd, items))
    assert sorted(map(tuple, found.collect()), key=repr) == hits([tuple(r) for r in odd.select("doc_id", "text").collect()], [tuple(r) for r in items.distinct().collect()])
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_index_is_written_and_read_shard_by_shard(spark, tmp_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: F.concat(F.lit("w"), F.pmod(F.xxhash64(x, "id"), F.lit(5000)))))
    docs = spark.range(700, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).coalesce(1)
    index = decontamination.build_index(docs)
    files = [pq.ParquetFile(unquote(f.removeprefix("file:"))).metadata for f in index.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 3 and set(groups) == {1}  # some 4 MB of text each
    rows = [tuple(r) for r in docs.where("doc_id % 100 = 0").collect()]
    items = spark.createDataFrame([(i, " ".join(t.split()[40 * i : 40 * i + 12])) for i, t in rows[:3]], "item_id long, text string")
    found = digest(decontamination.search(index, items))
    assert sorted(map(tuple, found.where("doc_id % 100 = 0").collect()), key=repr) == hits(rows, [tuple(r) for r in items.collect()])
    assert found.count() == 700


def test_places_at_once(monkeypatch):
    n = 20_000
    shard = decontamination._Shard({"terms": pa.scalar([7, 8]), "ends": pa.scalar([n, n + 10], pa.list_(pa.int32())), "places": pa.scalar([*range(10, n + 10), *range(10)], pa.list_(pa.int32())), "ids": pa.scalar([1, 2]), "n_words": pa.scalar([10, n], pa.list_(pa.int32()))}, np.array([7, 8]))
    phrases = np.array([[0] * 5 + [1] * 5, [1] * 10, [0] * 10, [1, 0, *[-1] * 8]] * 25)
    lengths = (phrases >= 0).sum(axis=1)

    def found_and_most():
        tracemalloc.start()
        begin, number = decontamination._phrases(shard, phrases, lengths)
        most = tracemalloc.get_traced_memory()[1] - begin.nbytes - number.nbytes
        tracemalloc.stop()
        return sorted(zip(number.tolist(), begin.tolist(), strict=True)), most

    whole, most = found_and_most()
    assert whole == sorted([(k, 0) for k in range(1, 100, 4)] + [(k, x) for k in range(2, 100, 4) for x in range(10, n + 1)])
    monkeypatch.setattr(decontamination, "MAX_PLACES", n)
    some, less = found_and_most()
    assert some == whole and less < most / 2


def test_contaminated_rows_go(spark):
    rows = [(1, "a b c d"), (1, "x y z"), (None, "a b c d"), (None, "x"), (2, None), (3, "b c d a b c")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, number int, digest int")
    stay = decontamination.without_contaminated(docs, spark.createDataFrame([(1, "a b c")], "item_id int, text string"))
    assert stay.columns == docs.columns and sorted((r[0], r[1]) for r in stay.where("text is not null and doc_id is not null").collect()) == [(1, "x y z")]
    assert stay.count() == 3


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha y beta z gamma"), (2, "gamma beta q alpha"), (3, "alpha " + "q " * 30 + "beta gamma"), (4, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id int, text string")
    found = decontamination.decontaminate(docs, items, span=6)
    assert {r["doc_id"] for r in found.collect() if r["matches"]} == {1, 2}


def fingerprint(text, width=4):
    w = split(lower(text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, odd, empty):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        fps = [fingerprint(r["text"]) for r in rows]
        want = sorted(zip([r["doc_id"] for r in rows], fps, classes([r["doc_id"] for r in rows], fps), strict=True), key=repr)
        found = simhash.near_fingerprints(df, radius=4, width=4).collect()
        assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found), key=repr) == want
    assert simhash.near_fingerprints(empty).count() == 0


def test_hashes_of_many_pieces():
    draw = np.random.default_rng(3)
    data = draw.integers(0, 256, 9000).astype(np.uint8)
    n = np.concatenate([np.arange(1200), draw.integers(0, 70, 9000)])
    starts = draw.integers(0, len(data) - 1200, len(n))
    want = [xxhash.xxh64_intdigest(data[a : a + k].tobytes(), 42) for a, k in zip(starts, n, strict=True)]
    assert W.xxh64(data, starts, starts + n).tolist() == want
    assert len(W.xxh64(data[:0], n[:0], n[:0])) == 0


@pytest.mark.parametrize(("rows", "radius", "blocks"), [(8192, 4, None), (50, 4, None), (64, 4, 6), (60, 9, 11)])
def test_near_links_lose_none(spark, monkeypatch, rows, radius, blocks):
    monkeypatch.setattr(simhash, "TABLE_ROWS", rows)  # tables in parts
    draw = np.random.default_rng(1)
    seeds = draw.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:  # chains of near ones
        for _ in range(6):
            for b in draw.choice(64, 4, replace=False):
                s = s ^ np.uint64(1 << int(b))
            fps.add(int(s))
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = simhash.components(simhash.near_links(table, radius, blocks))
    by = {r["node"] % (1 << 64): r["component"] for r in found.collect()}
    want = classes(fps, fps, radius)
    groups = lambda labels: {frozenset(f for f, x in zip(fps, labels, strict=True) if x == y) for y in set(labels)}
    assert groups([by.get(f, ("alone", f)) for f in fps]) == groups(want)


def test_sharding_law(spark, docs, odd, empty):
    records = docs.select("doc_id", sharding.sizes(F.col("text")).alias("size"))
    found = sharding.two_pass_shuffle(records, 16, bucket_bytes=3000)
    rows = found.collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted(map(tuple, records.collect()))
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 16 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.two_pass_shuffle(records, 16, bucket_bytes=3000).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, sharding.two_pass_shuffle(records, 16, bucket_bytes=3000, seed=7).collect()))
    placed = sharding.two_pass_shuffle(odd, 4)
    assert placed.count() == odd.count() and placed.where("doc_id is null").count() == 1
    assert sharding.two_pass_shuffle(empty, 4).count() == 0


def test_shuffle_is_uniform(spark):
    """Where each of 6 records of a bucket lands, over many seeds: chi-square of 25 degrees of freedom."""
    df = spark.range(6).select(F.col("id").alias("doc_id")).coalesce(1)
    counts = np.zeros((6, 6))
    for seed in range(36):
        for r in sharding.two_pass_shuffle(df, 1, seed=seed * 7).collect():
            counts[r["doc_id"], r["slot"]] += 1
    assert ((counts - 6) ** 2 / 6).sum() < 60


def test_write_shards(spark, docs, tmp_path):
    placed = sharding.two_pass_shuffle(docs, 3)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_word_hashes_don_t_depend_on_place():
    data = np.frombuffer("one two  one\tÉé two".encode(), np.uint8)
    starts, ends, first = W.bounds(data, np.array([0, len(data)]), W.whitespace_table())
    h = W.hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert int(h[3]) == W.word_hash("Éé")
    prefixes = W.hashes(data, starts, ends, (2,))
    assert (prefixes[1] == 0).tolist() == [False] * 5


def test_queries_digests(spark):
    found = queries.QUERIES["op7_substring_dedup"](spark, DATA).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in without_repeats(docs))
    assert sorted(map(tuple, found)) == want


def test_places_of_many_buckets_are_joined(docs, monkeypatch):
    def placed():
        return sorted(map(tuple, sharding.two_pass_shuffle(docs.select("doc_id"), 4, bucket_bytes=3000).collect()))

    near = placed()
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", 0)
    assert placed() == near


def test_texts_of_one_doc_id_and_one_tag(spark):
    """Two texts of a doc_id whose short tags agree: words are taken from the one that repeats them, not from the other."""
    shared = " ".join(f"s{k}" for k in range(20))
    by_tag, pair = {}, None
    for n in range(100_000):
        for kind, text in ((0, f"a{n} {shared}"), (1, " ".join(f"b{n}x{k}" for k in range(26)))):
            tag = xxhash.xxh64_intdigest(text, 42) >> 48
            if by_tag.setdefault((tag, kind), text) and (tag, 1 - kind) in by_tag:
                pair = by_tag[tag, 0], by_tag[tag, 1]
        if pair:
            break
    docs = spark.createDataFrame([(1, shared), (5, pair[0]), (5, pair[1]), (6, pair[1] + " end")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_duplicates(docs).collect())
    assert found == [(1, 20, 0), (5, 21, 20), (5, 26, 0), (6, 27, 26)]
