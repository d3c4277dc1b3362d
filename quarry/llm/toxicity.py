"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (letters, digits and characters beyond ASCII, A-Z in lower case) and the first 5 and 7 bytes of
longer words, so that inflected forms of one stem meet. Every term of the examples is weighed; none is cut by a count.
A term weighs (1 + log tf) * idf * g: document frequencies are counted over all documents, and g is how far its presence
tells the examples' labels apart, its log-likelihood ratio. Terms whose ratio is no more than chance alone would give on
average (``CHANCE``) say nothing: they weigh nothing and take no space in the index. Examples are a bounded, stratified sample of the labelled training rows (``EXAMPLES`` of
each label, by a hash of doc_id) without near copies, else each word of an often copied text would look telling: of two
texts of one label that share the smallest hash of their four-word runs and 0.8 of all of those, one stays.

The index stores each term's postings by block of ``BLOCK`` examples, with the largest weight of each block. A document
adds up the block maxima of its terms, takes the blocks in falling order of that bound and scores them exactly, until no
bound reaches its k-th best: the k nearest are exact. Examples lie in the order of their strongest terms, which keeps
like ones in one block and bounds tight. They vote with weight 1 / (distance + 0.05), each label weighted
back to its share of all labelled rows, over a prior; a logistic curve, fitted on the examples with each one left out,
turns the vote into a probability. The neighbours and their cosines are returned as evidence.

Defined results: null and empty texts, and texts without a term of the vocabulary, have no neighbours and get the
prior's score. Rows that repeat a doc_id are scored one by one. Labels that are null are no examples, and a doc_id that
is labelled twice counts once, with its larger label. Without examples of both labels every score is the share of label
1 (0 without labels). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.shared import give_back, held_out, keep

#: Examples of each label, at most.
EXAMPLES = 2000
#: The log-likelihood ratio that a term which says nothing has on average (chi-square, one degree of freedom).
CHANCE = 1.0
#: Examples of a block, and blocks that a document scores before it looks at its bounds again.
BLOCK, AT_ONCE = 64, 3
NEIGHBOURS = 15
PREFIXES = (5, 7)
_SCORED = "doc_id long, score double, neighbours array<struct<doc_id: long, toxic: int, cosine: double>>"
_NEIGHBOUR = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])


class Vocabulary:
    """Term hashes, sorted, with the place of the first one of each run of leading bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = min(22, max(1, len(terms).bit_length() + 1))
        self.first = np.searchsorted(terms >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max())

    def __len__(self) -> int:
        return len(self.terms)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The index of each term, -1 if it isn't held."""
        out = np.full(len(terms), -1, np.int64)
        run = (terms >> np.uint64(64 - self.bits)).astype(np.int64)
        at, left = self.first[run], np.arange(len(terms))
        n = self.first[run + 1] - at
        for k in range(self.longest):
            inside = n > k
            if not inside.all():
                at, n, left = at[inside], n[inside], left[inside]
            same = self.terms[at + k] == terms[left]
            out[left[same]] = at[same] + k
        return out


def term_counts(column: pa.Array, vocabulary: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every distinct term of each text, by row; with a vocabulary, the terms' places in it."""
    data, at = W.text_bytes(column)
    data = W.lower_table()[data]
    starts, ends, first_word = W.bounds(data, at, W.alphanumeric_table())
    terms = W.hashes(data, starts, ends, PREFIXES).T.ravel()  # those of a word side by side
    row = np.repeat(np.repeat(np.arange(len(at) - 1), np.diff(first_word)), 1 + len(PREFIXES))
    held = np.flatnonzero(terms)
    if vocabulary is None:
        distinct, code = np.unique(terms[held], return_inverse=True)
    else:
        distinct, code = vocabulary.terms, vocabulary.places(terms[held])
        held, code = held[code >= 0], code[code >= 0]
    base = max(1, len(distinct))
    pairs, counts = np.unique(row[held] * base + code, return_counts=True)
    row, code = pairs // base, pairs % base
    return row, (distinct[code].view(np.int64) if vocabulary is None else code), counts


def likelihood_ratio(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """How strongly the presence of a term tells labels apart: log-likelihood ratio from the examples that hold it."""

    def part(k: Column, n: int) -> Column:
        return F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / n / (1 - p))).otherwise(0.0)

    p = (pos + neg) / (n_pos + n_neg)
    return 2 * (part(pos, n_pos) + part(neg, n_neg))


@dataclass
class Index:
    """Examples by blocks. Postings are in order of (term, block), a cell; ``cells`` has the bounds of each term's cells
    and ``at`` those of each cell's postings; a cell has its block and the largest weight of its postings."""

    vocabulary: Vocabulary
    term_weight: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    weight: np.ndarray  # of each example's vote
    prior: float
    cells: np.ndarray
    block: np.ndarray
    most: np.ndarray
    at: np.ndarray
    example: np.ndarray
    value: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def build(cls, vocabulary, term_weight, ids, label, weight, prior, row, code, counts) -> Index:
        value = (1 + np.log(counts)) * term_weight[code]
        norm = np.sqrt(np.bincount(row, value * value, len(ids)))
        value = value / np.maximum(norm, 1e-12)[row]
        blocks = -(-len(ids) // BLOCK)
        cell = code.astype(np.int64) * blocks + row // BLOCK
        order = np.lexsort((row, cell))
        cell, row, value = cell[order], row[order].astype(np.int32), value[order]
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        most = np.maximum.reduceat(value, heads) if len(heads) else np.zeros(0)
        cells = np.searchsorted(cell[heads] // blocks, np.arange(len(term_weight) + 1))
        return cls(vocabulary, term_weight, ids, label, weight, prior, cells, (cell[heads] % blocks).astype(np.int32), most, np.append(heads, len(cell)), row, value)

    def nearest(self, code: np.ndarray, value: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (over zero), ties to the earlier example, and their cosines."""
        n = self.cells[code + 1] - self.cells[code]
        cells, by = W.ranges(self.cells[code], n), np.repeat(value, n)
        blocks = -(-len(self.ids) // BLOCK)
        bound = np.bincount(self.block[cells], self.most[cells] * by, blocks)
        order = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())]
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, AT_ONCE
        while done < len(order):
            # a few blocks at first, then all at once that still reach the k-th best
            least = cosine[-1] - 1e-9 if len(best) == k else 0.0
            reach = done + int((bound[order[done:]] >= least).sum())
            chosen = order[done : min(done + step, reach)]
            if not len(chosen):
                break
            now = np.zeros(blocks, bool)
            now[chosen] = True
            held = np.flatnonzero(now[self.block[cells]])
            n = self.at[cells[held] + 1] - self.at[cells[held]]
            postings = W.ranges(self.at[cells[held]], n)
            exact = np.bincount(self.example[postings], self.value[postings] * np.repeat(by[held], n), len(self.ids))
            found = np.flatnonzero(exact > 0)
            found = found[found != but]
            best, cosine = np.concatenate((best, found)), np.concatenate((cosine, exact[found]))
            if len(best) >= k:  # the last is the k-th best
                stay = np.lexsort((best, -cosine))[:k]
                best, cosine = best[stay], cosine[stay]
            done, step = done + len(chosen), blocks
        stay = np.lexsort((best, -cosine))
        return best[stay], cosine[stay]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the neighbours' weighted vote over one vote of the prior."""
        weight = self.weight[best] / (1.05 - np.minimum(cosine, 1))
        for_it = weight @ self.label[best] + self.prior
        return float(np.log(for_it / (weight.sum() + 1 - for_it)))

    def score(self, vote: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * vote + b, -30, 30)))

    def calibrate(self, votes: np.ndarray) -> None:
        """Fit the logistic curve to left-out votes by Newton steps, lightly held to the identity."""
        w = self.weight / self.weight.mean()
        x = np.stack([votes, np.ones(len(votes))])
        theta = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
            gradient = x @ (w * (self.label - p)) - (theta - [1.0, 0.0])
            theta = theta + np.linalg.solve((x * (w * p * (1 - p))) @ x.T + np.eye(2), gradient)
        self.curve = (max(0.05, float(theta[0])), float(theta[1]))


def _distinct(sample: DataFrame) -> DataFrame:
    """The sample without near copies: of texts of one label that share the smallest hash of four words in a row, those
    that also have a Jaccard similarity of 0.8 or more to the one of the smallest doc_id go."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text"):
            data, at = W.text_bytes(batch.column(2))
            starts, ends, first_word = W.bounds(data, at, W.whitespace_table())
            grams = W.gram_hashes(W.hashes(data, starts, ends), 4).view(np.int64)
            n = np.maximum(np.diff(first_word) - 3, 0)
            sets = [np.unique(grams[a : a + k]) for a, k in zip(first_word[:-1], n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "label", "grams"])

    described = keep(sample.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(runs, "doc_id long, label int, grams array<long>").where(F.size("grams") > 0), "example-runs")
    first = described.groupBy("label", F.element_at("grams", 1).alias("least")).agg(F.min_by("grams", "doc_id").alias("first"), F.min("doc_id").alias("first_id"))
    met = described.withColumn("least", F.element_at("grams", 1)).join(first, ["label", "least"]).where("doc_id <> first_id")
    both = F.size(F.array_intersect("grams", "first"))
    copies = met.where(both >= 0.8 * (F.size("grams") + F.size("first") - both)).select("doc_id")
    return keep(sample.join(F.broadcast(copies), "doc_id", "left_anti"), "distinct-examples")  # as few rows as the sample


def _examples(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """The sample (doc_id, text, label) and how many labelled rows there are of each label."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    n = {int(k): c for k, c in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # per_label rows of each label at most
    return texts.join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), n


def fit(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES) -> Index | float:
    """The index of examples; the share of label 1 where there is nothing to tell the labels apart."""
    sample, n = _examples(docs, labels, per_label)
    share = n.get(1, 0) / max(1, sum(n.values()))
    sample = _distinct(keep(sample, "examples"))
    of_label = {int(y): c for y, c in sample.groupBy("label").count().collect()}
    if len(of_label) < 2:
        return share

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text"):
            row, term, _ = term_counts(batch.column(1))
            terms, code = np.unique(term, return_inverse=True)
            pos = np.bincount(code, batch.column(0).to_numpy()[row], len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(pos), pa.array(np.bincount(code, minlength=len(terms)) - pos)], names=["term", "pos", "neg"])

    counted = sample.select(F.col("label").cast("int"), "text").mapInArrow(presence, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    telling = counted.select("term", likelihood_ratio(F.col("pos"), F.col("neg"), of_label[1], of_label[0]).alias("ratio")).where(F.col("ratio") > CHANCE)
    held = telling.toArrow()  # terms of 2 * per_label texts
    if not held.num_rows:
        return share
    terms = held.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    strength, vocabulary = held.column("ratio").to_numpy()[order], Vocabulary(terms[order])
    del held, terms
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text"):
            row, code, tf = term_counts(batch.column(2), shared.value)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "label", "codes", "counts"])

    terms_of = sample.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(described, "doc_id long, label int, codes array<int>, counts array<int>")
    rows = terms_of.orderBy("doc_id").toArrow().combine_chunks()  # 2 * per_label rows at most, without their texts
    label = rows.column("label").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label), dtype=np.int32), np.asarray(pa.compute.list_value_length(rows.column("codes"))))
    code, tf = (np.asarray(pa.compute.list_flatten(rows.column(c))) for c in ("codes", "counts"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        total, size = np.zeros(len(held), np.int64), 0
        for batch in W.slabs(batches, "text"):
            total += np.bincount(term_counts(batch.column(0), held)[1], minlength=len(held))
            size += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), -1)), pa.array(np.append(total[total > 0], size))], names=["code", "n"])

    counts = docs.select("text").mapInArrow(frequency, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the vocabulary
    shared.destroy()
    at, times = counts.column("code").to_numpy(), counts.column("n").to_numpy()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[at] = times  # the last one: all documents
    n_pos, n_neg = of_label[1], of_label[0]
    weight_of = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * strength
    weight = np.where(label == 1, n[1] / n_pos, n[0] / n_neg)
    # examples in the order of their strongest terms
    strongest = np.full(len(label), -1)
    by_weight = np.argsort((1 + np.log(tf)) * weight_of[code], kind="stable")
    strongest[row[by_weight]] = code[by_weight]
    rank = np.argsort(np.lexsort((label, strongest))).astype(np.int32)
    rows, label, weight = (x.take(np.argsort(rank)) for x in (rows, label, weight))
    order = np.argsort(rank[row], kind="stable")
    row, code, tf = rank[row][order], code[order], tf[order]
    index = Index.build(vocabulary, weight_of, rows.column("doc_id").to_numpy(), label, weight / weight.mean(), share, row, code, tf)
    votes = [index.vote(*index.nearest(c, v, NEIGHBOURS, i)) for i, c, v in _vectors(index, len(label), row, code, tf)]
    index.calibrate(np.array(votes))
    return index


def _vectors(index: Index, n: int, row, code, tf) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row's terms and unit weights."""
    value = (1 + np.log(tf)) * index.term_weight[code]
    edges = np.searchsorted(row, np.arange(n + 1))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        yield i, code[a:b], value[a:b] / max(1e-12, float(np.sqrt(value[a:b] @ value[a:b])))


def score(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, per_label: int = EXAMPLES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its score and evidence: doc_id, score, neighbours.

    ``labels``: doc_id, toxic (0 or 1). Score: probability of label 1. neighbours: the nearest examples, nearest first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = fit(docs, labels, per_label)
    if not isinstance(index, Index):
        none = F.array().cast("array<struct<doc_id: long, toxic: int, cosine: double>>")
        return rows.select("doc_id", F.lit(float(index)).alias("score"), none.alias("neighbours"))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the postings of 2 * per_label texts
    del index
    give_back()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in W.slabs(batches, "text"):
            found = [index.nearest(c, v, neighbours) for _, c, v in _vectors(index, batch.num_rows, *term_counts(batch.column(1), index.vocabulary))]
            votes = np.array([index.vote(*x) for x in found])
            best, cosine = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            ends = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
            fields = [pa.array(index.ids[best.astype(np.int64)]), pa.array(index.label[best.astype(np.int64)].astype(np.int32)), pa.array(cosine)]
            evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_NEIGHBOUR)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.score(votes)), evidence], names=["doc_id", "score", "neighbours"])

    return rows.mapInArrow(near, _SCORED)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, all columns as they are; null and empty texts stay."""
    index = fit(docs, labels)
    if not isinstance(index, Index):
        return docs if index < threshold else docs.where("text is null or text = ''")
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the postings of 2 * EXAMPLES texts
    del index
    give_back()
    text = docs.columns.index("text")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in W.slabs(batches, "text"):
            column = batch.column(text)
            votes = np.array([index.vote(*index.nearest(c, v, NEIGHBOURS)) for _, c, v in _vectors(index, batch.num_rows, *term_counts(column, index.vocabulary))])
            empty = pa.compute.equal(pa.compute.binary_length(pa.compute.fill_null(column, "")), 0)
            yield batch.filter(pa.compute.or_(pa.array(index.score(votes) < threshold), empty))

    return docs.mapInArrow(filtered, docs.schema)
