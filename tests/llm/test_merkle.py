"""Merkle manifest against a plain construction in Python, and against its SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from compare import SF, same
from pyspark.sql import functions as F

from quarry.llm import merkle
from quarry.llm.queries import ORACLES, QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    """Root of a row of digests, and for each the siblings on its way: (before, after) level by level."""
    ways = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for way, at in zip(ways, place, strict=True):
            way.append((runs[at // 3][: at % 3], runs[at // 3][at % 3 + 1 :]))
        place, nodes = [at // 3 for at in place], [sha("".join(run)) for run in runs]
    return nodes[0], ways


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for row in rows:
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
        by["" if row[1] is None else "=" + row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row[0], leaf((*row[:4], row[4].replace("\n", ""))) if changed else leaf(row)))
    sources = sorted(by, key=str.encode)
    trees = {k: (sorted(by[k]), *grown([x[2] for x in sorted(by[k])])) for k in sources}
    root, upper = grown([trees[k][1] for k in sources])
    out = []
    for k, above in zip(sources, upper, strict=True):
        members, subroot, ways = trees[k]
        for (_, _, digest, doc_id, odd), way in zip(members, ways, strict=True):
            fold, proof = odd, ""
            for before, after in way + above:
                fold, proof = sha("".join([*before, fold, *after])), proof + "".join(before + after)
            out.append((doc_id, digest, subroot, root, sha(proof), fold, fold == root))
    return sorted(out, key=repr)


def found(docs, **more):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(changed, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, "source", "doc_id", FIELDS, {"text": text}, **more)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize(
    ("sizes", "levels", "broadcast"),
    [({}, 3, 100), ({"a": 1}, 3, 100), ({None: 1, "a": 1}, 1, 0), ({"": 9, "b": 10, "ä": 28, "z": 1}, 1, 0), ({"a": 83, "b": 1, "c": 82}, 3, 100)],
)
def test_trees(spark, monkeypatch, sizes, levels, broadcast):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BROADCAST", broadcast)
    rows = [(k * 7 % 101 - 3, source, None if k % 3 else "en", k, f"text\n{k}" * (k % 4)) for source, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert rows_of(found(docs)) == (plain(rows) if rows else [])


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    rows += rows[:4]  # rows that repeat as a whole
    docs = odd.unionByName(spark.createDataFrame(rows[:4], odd.select(*FIELDS).schema).select(*[c if c in FIELDS else F.lit("clash").alias(c) for c in odd.columns]))
    assert rows_of(found(docs)) == plain([tuple(r) for r in docs.select(*FIELDS).collect()])


def test_siblings_fold_to_the_root(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in found(docs).limit(50).collect():
        fold = r["leaf"]
        for step in r["siblings"]:
            n, digests = step[0], step[1:].hex()
            fold = sha(digests[: 64 * n] + fold + digests[64 * n :])
        assert fold == r["root"] and (r["folded_root"] == fold) == r["verified"]


def test_against_sql(spark, duck):
    same(QUERIES["op12_merkle_manifest"](spark, SF), duck, ORACLES["op12_merkle_manifest"])
