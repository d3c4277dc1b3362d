"""Collocations against a plain count in Python, and against their SQL."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SF, same
from conftest import lower

from quarry.llm import collocations as C
from quarry.llm.queries import ORACLES, QUERIES


def plain(rows, wanted, least, share):
    """lang, rank, phrase, a, l, r, n, score of rows (text, lang)."""
    counts, out = defaultdict(Counter), []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= share * a and p in (q[:2], q[1:]) for q, b in often.items()):
                continue
            cuts = [(C.SCALE * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, phrase.decode(), -a, left, right, n, -score) for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:wanted], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made_up(seed=3):
    rng = np.random.default_rng(seed)
    words = np.array([*"abcdefgh", "New", "YORK", "x.y", "ß", "日本", "z"])
    texts = []
    for k in range(160):
        row = words[np.minimum(rng.geometric(0.25, 30), len(words)) - 1].tolist()
        row[5:8], row[12:14] = ["New", "York", "City"] if k % 2 else ["new", "york", "c"], ["rare", f"w{k}"]
        texts.append(("".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ". ", "\n"]) for w in row), [None, "en", "und", "a b"][k % 4]))
    return texts


@pytest.mark.parametrize(("first", "step", "wanted", "least", "share", "bits"), [(1, 2, 10, 3, 50, 25), (4, 16, 2000, 3, 50, 8), (2, 3, 3, 5, 90, 12)])
def test_counts(spark, monkeypatch, first, step, wanted, least, share, bits):
    """Few and many wanted phrases (up to three thresholds), and bitmaps so small that they let nearly all through."""
    for name, value in (("FIRST", first), ("STEP", step), ("BITS", bits), ("SLAB_BYTES", 2000)):
        monkeypatch.setattr(C, name, value)
    rows = made_up()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert rows_of(C.collocations(docs, wanted=wanted, least=least, share=share)) == plain(rows, wanted, least, share)


def test_odd_rows(spark, odd, empty):
    docs = odd.unionByName(odd).unionByName(odd)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert rows_of(C.collocations(docs, least=3)) == plain(rows, 2000, 3, 50)
    assert C.collocations(empty).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    row = spark.range(1).selectExpr(f"{C._score(f'{big}L', f'{big + 7}L', f'{big + 1}L')} AS s").first()
    assert row["s"] == C.SCALE * big * big // ((big + 7) * (big + 1))


def test_against_sql(spark, duck):
    same(QUERIES["op13_collocations"](spark, SF), duck, ORACLES["op13_collocations"])
