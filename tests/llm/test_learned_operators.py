"""Learned operators and those on other tables: brute force, held-out accuracy, and edge cases."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import lower

from quarry.llm import mixing, neighbours, quality, queries, revisits, secret_scan, toxicity

DATA = "/root/testdata/sf0.01"


def table(spark, name, data=DATA):
    return spark.read.parquet(f"{data}/{name}.parquet")


def small_index(seed=0, n=300, terms=40):
    draw = np.random.default_rng(seed)
    row = np.repeat(np.arange(n), 5)
    code = np.concatenate([np.sort(draw.choice(terms, 5, replace=False)) for _ in range(n)])
    tf = draw.integers(1, 6, len(row))
    label = (draw.random(n) < 0.4).astype(np.int64)
    idf = draw.random(terms) + 1
    return toxicity.Index.build(toxicity.Vocabulary(np.arange(terms, dtype=np.uint64)), idf, np.arange(n) + 1000, label, np.ones(n), 0.4, row, code, tf), row, code, tf


@pytest.mark.parametrize("k", [1, 5, 15, 400])
def test_block_max_search_is_exact(k):
    index, row, code, tf = small_index()
    dense = np.zeros((300, 40))
    dense[row, code] = (1 + np.log(tf)) * index.term_weight[code]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for i, c, v in toxicity._vectors(index, 300, row, code, tf):
        best, cosine = index.nearest(c, v, k, but=i)
        exact = dense @ dense[i]
        exact[i] = -1
        want = np.sort(exact[exact > 1e-12])[::-1][:k]
        assert np.allclose(cosine, want) and np.allclose(exact[best], cosine)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").toPandas()
    hit = (rows.score >= 0.5) == (rows.toxic == 1)
    assert hit.mean() > 0.98 and ((rows.score >= 0.5) & (rows.toxic == 0)).mean() < 0.01
    assert hit[rows.toxic == 1].mean() >= 0.9
    assert ((rows.score - rows.toxic) ** 2).mean() < 0.03


def test_neighbours_of_texts_against_plain_python(spark):
    """Terms, counts over all documents, weights and cosines from the texts alone."""
    docs, labels = table(spark, "documents", "/root/testdata/sf0.001"), table(spark, "labels", "/root/testdata/sf0.001")
    index = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def terms(text):
        found = {}
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", lower(text).encode()):
            for t in [w, *((n, w[:n]) for n in toxicity.PREFIXES if len(w) > n)]:
                found[t] = found.get(t, 0) + 1
        return found

    of = {d: terms(t) for d, t in texts.items()}
    toxic = dict(zip(index.ids.tolist(), index.label.tolist(), strict=True))
    known = {t for d in toxic for t in of[d]}
    df, held = {}, {}
    for d, found in of.items():
        for t in found:
            df[t] = df.get(t, 0) + 1
            if d in toxic:
                held.setdefault(t, [0, 0])[toxic[d]] += 1
    n = [sum(1 for y in toxic.values() if y == k) for k in (0, 1)]

    def ratio(t):
        total, p = 0.0, sum(held[t]) / sum(n)
        for k, size in zip(held[t], n, strict=True):
            total += k * math.log(k / size / p) if k else 0
            total += (size - k) * math.log((size - k) / size / (1 - p)) if k < size else 0
        return 2 * total if 2 * total > toxicity.CHANCE + 1e-9 else 0

    weight = {t: (math.log((1 + len(texts)) / (1 + df[t])) + 1) * ratio(t) for t in known}

    def vector(d):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in of[d].items() if t in known}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    vectors = {d: vector(d) for d in texts}
    for r in toxicity.score(docs, labels, neighbours=7).collect():
        mine = vectors[r["doc_id"]]
        cosine = {e: sum(x * vectors[e].get(t, 0.0) for t, x in mine.items()) for e in toxic}
        want = sorted((c for c in cosine.values() if c > 1e-12), reverse=True)[:7]
        assert np.allclose([e["cosine"] for e in r["neighbours"]], want) and len(want) == len(r["neighbours"])
        assert all(e["toxic"] == toxic[e["doc_id"]] and abs(cosine[e["doc_id"]] - e["cosine"]) < 1e-9 for e in r["neighbours"])


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (7, 0), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, labels).count() == odd.count()
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(empty, labels).count() == 0
    docs, own = table(spark, "documents"), table(spark, "labels")
    scored = toxicity.score(docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))), own)
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.without_toxic(docs, own).columns == docs.columns


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    for module in (toxicity, quality):
        a, b = (dict(map(tuple, module.score(docs, x).select("doc_id", F.round("score", 9)).collect())) for x in (labels, flipped))
        assert a == b


def test_pairwise_ranking_recovers_weights():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, len(quality.FEATURES)))
    worth = 3 * x[:, 0] - 2 * x[:, 3]
    good, bad = x[worth > -1], x[worth <= -1]
    model = quality.rank(good, bad, len(bad) / len(x))
    assert (model.worth(good)[:500, None] > model.worth(bad)[None, :500]).mean() > 0.97
    assert abs((model.worth(x) < model.threshold).mean() - len(bad) / len(x)) < 0.02


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    rows = quality.score(docs, labels).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").toPandas()
    assert ((rows.score >= 0.3) == (rows.quality == 1)).mean() > 0.98
    assert ((rows.score - rows.quality) ** 2).mean() < 0.03


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (5, 0), (7, 1)], "doc_id long, quality int")
    found = quality.score(odd, labels)
    assert found.count() == odd.count() and found.where("score is null or isnan(score)").count() == 0
    assert quality.score(empty, labels).count() == 0
    assert quality.keep_best(table(spark, "documents"), table(spark, "labels"), 0.2).count() == pytest.approx(800, abs=25)


def test_features_of_empty_and_odd_texts():
    x = quality.features(pa.array(["", None, " ", "a", "A!! B!! A!! B!!", "x " * 5000]))
    assert np.isfinite(x).all()
    assert (x[0] == x[1]).all()


def brute(ids, x, k):
    """Of every row whose id is divisible by 100: id, and id and distance of the k nearest other rows."""
    out = []
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)) if j != i][:k]
        out.append((int(ids[i]), [(int(ids[j]), float(far[j])) for j in order]))
    return out


def test_recall_of_neighbours(spark):
    data = table(spark, "embeddings", "/root/testdata/sf0.1")
    rows = data.orderBy("vec_id").toPandas()
    want = dict(brute(rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float64), 10))
    found = {}
    for r in neighbours.nearest(data, F.expr("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = sum(len({v for _, v, _ in found[q]} & {v for v, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([r for r, _, _ in sorted(f)] == list(range(1, 11)) for f in found.values())


def test_neighbours_odd(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 7)  # parts in chunks
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)  # queries in blocks
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    # repeated ids, as candidates and as queries, with equal vectors and with others
    good = [(100 * i, [1.0, float(i)]) for i in range(5)] + [(i, [1.0, 1.0]) for i in range(50, 80)] + [(50, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [3.0, 0.5]), (200, [1.0, 2.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash")).withColumn("row", F.lit("clash"))
    for k in (3, 60):
        rows = neighbours.nearest(df, F.expr("vec_id % 100 = 0 or vec_id = 2"), k=k).collect()
        want = brute(np.array([g[0] for g in good]), np.array([g[1] for g in good]), k)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == sorted((q, n + 1, v, d) for q, near in want for n, (v, d) in enumerate(near))
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_balanced_parts():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1024, 8)) + np.repeat(draw.normal(size=(8, 8)) * 6, 128, axis=0)
    graph = neighbours._near(x, x, 10, np.arange(1024))
    part = neighbours.balanced_parts(x, graph, 8)
    assert np.bincount(part).max() <= 1.06 * 128 + 1
    assert (part[graph] == part[:, None]).mean() > 0.9


RECORDS = [
    (1, "http://www.A.org/x/", 10, "response", "e1", "d1", "h1", {"Content-Type": "t", "Date": "1"}),
    (2, "https://a.org:443/x/?utm_source=q#top", 20, "revisit", "W/e1", None, None, {"date": "2", "Server": "no", "ETag": "e1"}),
    (3, "A.ORG:80/x/", 30, "revisit", "e2", "d1", None, {"date": "3"}),
    (4, "a.org/x/", 40, "response", None, "d2", "h2", None),
    (5, "a.org/x/", 40, "revisit", "e1", "d2", None, {"expires": "5"}),
    (6, "a.org/x/", 5, "revisit", "e1", None, None, {}),
    (7, None, 50, "revisit", "e1", None, None, None),
    (8, "b.org", 1, "revisit", None, None, None, None),
    (9, "a.org/x/", None, "response", "e0", None, None, None),
    (10, "a.org/x/?id=2&ref=3", 60, "revisit", "e1", None, "h2", None),
    (11, "a.org/X/", 70, "revisit", "e1", "d2", "h2", None),
    (12, "m.a.org/x/", 70, "revisit", "e1", "d2", "h2", None),
    (13, "a.org/x/", 80, "revisit", None, None, "h2", None),
    (13, "a.org/x/", 80, "revisit", None, None, "h2", None),
    (14, "", 90, "revisit", "e1", None, None, None),
    (15, "a.org/x/", 95, None, "e9", None, None, None),
    (16, "a.org/x/", 99, "revisit", None, None, "h2", {"date": "16"}),
]
FIELDS = "record_id long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits(spark):
    found = revisits.resolve(spark.createDataFrame(RECORDS, FIELDS).withColumn("before", F.lit(1)).withColumn("status", F.lit("x"))).collect()
    rows = {r["record_id"]: r for r in found}
    assert len(found) == len(RECORDS) and {k: (r["status"], r["refers_to"], r["validator"]) for k, r in rows.items()} == {
        1: ("full", None, None), 2: ("resolved", 1, "etag"), 3: ("mismatch", 1, "etag"), 4: ("full", None, None), 5: ("resolved", 4, "last-modified"),
        6: ("mismatch", 9, "etag"), 7: ("no-url", None, None), 8: ("no-response", None, None), 9: ("full", None, None), 10: ("no-response", None, None),
        11: ("no-response", None, None), 12: ("no-response", None, None), 13: ("resolved", 4, "digest"), 14: ("no-url", None, None), 15: ("full", None, None), 16: ("resolved", 4, "digest"),
    }
    assert rows[2]["headers"] == {"content-type": "t", "date": "2", "etag": "e1"}
    assert rows[3]["headers"] is None and rows[4]["headers"] is None and rows[13]["headers"] == {} and rows[16]["headers"] == {"date": "16"}
    assert revisits.resolve(spark.createDataFrame([], FIELDS)).count() == 0


def test_clustered_vectors_need_few_parts(spark, monkeypatch):
    """On vectors in clusters the router asks for few parts and still finds the neighbours; several blocks of queries a part."""
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    draw = np.random.default_rng(11)
    x = draw.normal(0, 1, (40, 16))[draw.integers(0, 40, 4000)] * 3 + draw.normal(0, 0.4, (4000, 16))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = neighbours.vectors(table, "vec_id", "embedding", F.col("vec_id") % 10 == 0)
    router = neighbours.fit(rows, 16, 10)
    assert router.probes <= 4
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 10 == 0, parts=16).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 10):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 4000


def test_parameters_of_one_name_keep_their_order(spark):
    rows = spark.createDataFrame([("http://h/p?b=1&a=2&b=0&a",), ("http://h/p?b=0&a=2&b=1&a",), ("http://h/p?a=2&b=1&a&b=0",)], "u string")
    found = [r[0] for r in rows.select(revisits.canonical_url(F.col("u"))).collect()]
    assert found == ["h/p?a=2&a&b=1&b=0", "h/p?a=2&a&b=0&b=1", "h/p?a=2&a&b=1&b=0"]


def test_canonical_urls(spark):
    same = [("http://X.org", "x.org/"), ("https://www.x.org:443/a?b=2&a=1", "http://x.org:80/a?a=1&b=2"), ("x.org/a?utm_source=m#f", "x.org/a"), ("x.org?", "x.org/")]
    other = [("x.org/a", "x.org/A"), ("x.org/a", "x.org/a/"), ("x.org", "m.x.org"), ("x.org/?a=1", "x.org/?a=2"), ("http://x.org:443", "x.org"), ("x.org/?ref=1", "x.org/")]
    rows = spark.createDataFrame(same + other, "a string, b string").select(*[revisits.canonical_url(F.col(c)).alias(c) for c in "ab"]).collect()
    assert [r["a"] == r["b"] for r in rows] == [True] * len(same) + [False] * len(other)


def test_as_of_join_of_a_hot_key(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), "hot" if i % 3 else f"k{i % 7}", int(draw.integers(0, 500)), int(i) if draw.random() < 0.1 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long").repartition(6)
    found = {r["id"]: r["before"] for r in revisits.as_of(df, "k", ["t", "id"], F.col("v")).collect()}
    want, last = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert found == want


def test_secrets(spark, odd, empty):
    secret = [(100 + i, f'the config has token = "{i:03d}{"9f3ab27c1d" * 4}"[:40] here {i} 47346632198668{i % 90 + 10}', "en", "s", 9) for i in range(60)]
    docs = spark.createDataFrame(secret, "doc_id long, text string, lang string, source string, n_chars long")
    words = spark.createDataFrame([("config",), (None,), ("Token",)], "word string")
    found = secret_scan.scan(docs, words).toPandas()
    keys = found.candidate.str.len() > 30
    assert keys.sum() == 60 and (found.probability[keys] > 0.9).all() and (found.probability[~keys] < 0.1).all()
    given = spark.createDataFrame([(r.doc_id, r.candidate, int(len(r.candidate) < 30)) for r in found.itertuples()], "doc_id long, candidate string, label int")
    turned = secret_scan.scan(docs, words, given).toPandas()
    assert (turned.probability[turned.candidate.str.len() > 30] < 0.1).all()
    assert secret_scan.scan(odd, words).count() == 0
    assert secret_scan.scan(empty, words).count() == 0


def test_candidates_stand_where_they_say(spark):
    docs = table(spark, "documents")
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    rows = secret_scan.found(docs).collect()
    assert rows
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["start"] + len(r["candidate"])] == r["candidate"]
        assert texts[r["doc_id"]].count(r["candidate"]) == r["n_found"]


def test_raking_meets_all_targets(spark):
    docs = table(spark, "documents")
    targets = queries.mix_targets(spark)
    rows = docs.withColumn("topic", mixing.topic(F.col("text"))).withColumn("tokens", mixing.tokens(F.col("text")))
    cells = rows.groupBy(*targets).agg(F.sum("tokens").alias("tokens"))
    raked = mixing.rake(cells, targets).toPandas()
    assert raked.weight.sum() == pytest.approx(1)
    for name, goal in queries.MIX.items():
        got = raked.groupby(name).weight.sum()
        present = {k: v for k, v in goal.items() if k in got.index}
        for value, share in present.items():
            assert got[value] == pytest.approx(share / sum(present.values()), abs=1e-8)


def test_targets_that_cannot_be_met_together(spark):
    cells = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "source string, lang string, tokens long")
    targets = {"source": mixing.target_table(spark, {"a": 0.9, "b": 0.1}), "lang": mixing.target_table(spark, {"x": 0.5, "y": 0.5})}
    assert {r["weight"] for r in mixing.rake(cells, targets).collect()} == {0.5}  # the last dimension's


def test_rates_of_full_cells(spark):
    raked = spark.createDataFrame([(1, 0.5, 10), (2, 0.3, 100), (3, 0.2, 100), (4, 0.0, 40)], "cell int, weight double, tokens long")
    rate = {r["cell"]: r["rate"] for r in mixing.with_rates(raked, 0.4).collect()}  # 100 of 250 tokens: 10 from the first cell, 90 by weight from the others
    assert rate == pytest.approx({1: 1.0, 2: 0.54, 3: 0.36, 4: 0.0})
    assert {r["rate"] for r in mixing.with_rates(raked.where("cell < 4"), 1.0).collect()} == {1.0}


def test_mixing_rates_and_draws(spark, odd, empty):
    docs, targets = table(spark, "documents"), queries.mix_targets(spark)
    rows = mixing.mix(docs, targets, 0.3).toPandas()
    assert len(rows) == docs.count() and rows.rate.between(0, 1).all()
    assert (rows.rate * rows.tokens).sum() == pytest.approx(0.3 * rows.tokens.sum(), rel=0.01)
    again = mixing.mix(docs.repartition(7), targets, 0.3).toPandas()
    assert set(rows.doc_id[rows.chosen]) == set(again.doc_id[again.chosen])
    placed = mixing.mix(odd.withColumn("source_cell", F.lit(1)), targets, 0.5)
    assert "source_cell" in placed.columns
    assert placed.count() == odd.count() and placed.where("rate is null").count() == 0
    assert mixing.mix(empty, targets, 0.5).count() == 0


def test_neighbour_queries_have_their_columns(spark):
    for name, query in queries.QUERIES.items():
        if name in ("op2_revisits", "op4_neighbours", "op6_sharding", "op8_mixing"):
            assert query(spark, DATA).count() > 0
