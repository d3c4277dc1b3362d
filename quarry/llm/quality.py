"""Quality by Bradley-Terry pairwise ranking.

Each whole text is described by ``FEATURES`` (shape of words, letter case, symbols, repetition). From the labelled
training rows, a bounded sample of each label (``EXAMPLES``, by a hash of doc_id), preference pairs are drawn: a text of
label 1 over one of label 0. Each text's worth is linear in its features, and the chance that one is preferred is the
logistic function of the difference of their worths, so the weights are learned by logistic loss on feature
differences. Worths rank documents; the threshold is a quantile of the sample's worths, the share of label 0 among the
labelled rows, and the score is a logistic curve through it: ``THRESHOLD`` at the quantile.

Defined results: a null text counts as empty; empty texts have a worth like any other (no words). Rows that repeat a
doc_id are scored one by one. Labels that are null are not learned, and a doc_id that is labelled twice counts once,
with its smaller label. Without both labels every score is the share of label 1 (0 without labels). Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.shared import held_out

#: Texts of each label that are learned from, at most, and preference pairs drawn from them.
EXAMPLES, PAIRS = 6000, 120_000
#: The score at the chosen quantile of worth.
THRESHOLD = 0.3
FEATURES = ("log_words", "short", "word_length", "long_words", "upper", "capital_words", "symbols", "marked_words", "bars", "digits", "beyond_ascii", "distinct", "next_same", "repeated_grams", "top_word", "ends", "commas")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    data, at = W.text_bytes(column)
    n = len(at) - 1
    starts, ends, first_word = W.bounds(data, at, W.whitespace_table())
    n_words = np.diff(first_word)
    row = np.repeat(np.arange(n), n_words)
    totals = lambda values: np.bincount(row, values, n)
    kind = np.zeros(256, np.int8)  # 1 upper, 2 lower, 3 digit, 4 beyond ASCII, 5 end of sentence, 6 comma, 7 bar, 8 other symbol
    kind[0x21:0x7F] = 8
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[0x80:] = 1, 2, 3, 4
    kind[list(b".!?")], kind[list(b",;:'\"()-")], kind[ord("|")] = 5, 6, 7
    of = kind[data]
    size = np.diff(at)

    def count(k: int) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of == k, dtype=np.int64)))
        return sums[at[1:]] - sums[at[:-1]]

    def in_words(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return sums[ends] - sums[starts]

    upper, lower, digit, beyond, stops, commas, bars, symbols = (count(k) for k in range(1, 9))
    word_upper = in_words(of == 1)
    marks = in_words((of == 8) | (of == 7) | (data == 0x21))
    lengths = ends - starts
    words = W.hashes(data, starts, ends)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])

    def repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text and how often its most frequent one occurs."""
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        heads = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1]))) if len(v) else np.zeros(0, np.int64)
        most = np.zeros(n)
        np.maximum.at(most, o[heads], np.diff(np.append(heads, len(v))))
        return np.bincount(o[heads], minlength=n), most

    distinct, most = repeats(words, row)
    n_grams = np.maximum(n_words - 3, 0)
    grams = W.gram_hashes(words, 4)[W.ranges(first_word[:-1], n_grams)] if len(words) >= 4 else np.zeros(0, np.uint64)
    distinct_grams, _ = repeats(grams, np.repeat(np.arange(n), n_grams))
    letters = upper + lower + beyond
    return np.stack(
        [
            np.log1p(n_words),
            np.exp(-n_words / 20),
            _share(totals(lengths), n_words),
            _share(totals(lengths > 12), n_words),
            _share(upper, letters),
            _share(totals((word_upper > 1) & (word_upper * 2 > lengths)), n_words),
            _share(symbols, size),
            _share(totals(marks > 1), n_words),
            _share(bars, n_words),
            _share(digit, size),
            _share(beyond, letters),
            _share(distinct, n_words),
            _share(totals(same), n_words),
            1 - (distinct_grams + (n_grams == 0)) / np.maximum(n_grams, 1),
            _share(most, n_words),
            _share(stops, n_words),
            _share(commas, n_words),
        ],
        axis=1,
    )


def _shaped(x: np.ndarray) -> np.ndarray:
    """Features and their square roots: most are shares of which the first few percent matter most."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


@dataclass
class Ranking:
    """Worth of a text: ``(shaped features - mean) / spread @ weights``; score: a logistic curve of it."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((_shaped(x) - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = (self.worth(x) - self.threshold) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def rank(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs: int = PAIRS, penalty: float = 1.0, seed: int = 9) -> Ranking:
    """Bradley-Terry weights from pairs of a row of ``good`` over one of ``bad``; Newton steps on the logistic loss."""
    both = np.concatenate([_shaped(good), _shaped(bad)])
    model = Ranking(both.mean(0), both.std(0) + 1e-9, np.zeros(both.shape[1]))
    g, b = (np.clip((_shaped(x) - model.mean) / model.spread, -6, 6) for x in (good, bad))
    draw = np.random.default_rng(seed)
    difference = g[draw.integers(0, len(g), pairs)] - b[draw.integers(0, len(b), pairs)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(difference @ model.weights, -30, 30)))
        gradient = difference.T @ (1 - p) - penalty * model.weights
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference + penalty * np.eye(len(gradient))
        step = np.linalg.solve(curvature, gradient)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break
    worth = np.concatenate([model.worth(good), model.worth(bad)])
    weight = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    order = np.argsort(worth)
    at = np.searchsorted(np.cumsum(weight[order]), share_bad)
    model.threshold = float(worth[order][min(at, len(order) - 1)])
    model.scale = max(1e-3, float(worth.std()) / 4)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES) -> Ranking | float:
    """A ranking learned from the labelled rows that aren't held out; the share of label 1 where one label is missing."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    n = {int(k): c for k, c in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # per_label rows of each label at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text"):
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = texts.select("doc_id", "label", "text").mapInArrow(describe, "doc_id long, label int, x array<double>").orderBy("doc_id", "x").toArrow()
    label = rows.column("label").to_numpy()
    share_bad = n.get(0, 0) / max(1, sum(n.values()))
    if len(set(label.tolist())) < 2:
        return 1 - share_bad if n else 0.0
    x = np.array(rows.column("x").to_pylist())
    return rank(x[label == 1], x[label == 0], share_bad)


def score(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its score: doc_id, score, worth.

    ``labels``: doc_id, quality (0 or 1). Worth orders documents; score is its logistic curve, ``THRESHOLD`` at the
    quantile of worth that the share of label 0 names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels, per_label)
    if not isinstance(model, Ranking):
        return rows.select("doc_id", F.lit(float(model)).alias("score"), F.lit(None).cast("double").alias("worth"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text"):
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), pa.array(model.worth(x))], names=["doc_id", "score", "worth"])

    return rows.mapInArrow(judge, "doc_id long, score double, worth double")


def keep_best(docs: DataFrame, labels: DataFrame, quantile: float) -> DataFrame:
    """Rows of ``docs`` whose worth is over that quantile of all rows' worths (approximate quantile)."""
    if not 0 <= quantile <= 1:
        raise ValueError("quantile: 0 to 1")
    scored = score(docs, labels)
    at = scored.agg(F.percentile_approx("worth", F.lit(quantile), F.lit(10_000))).first()[0]
    best = scored.where(F.lit(True) if at is None else F.col("worth") > at).select("doc_id").distinct()
    return docs.join(best, docs["doc_id"].eqNullSafe(best["doc_id"]), "left_semi")
