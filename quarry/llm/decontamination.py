"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of the training texts by document shard (a few MB of texts): every term of the shard
with the sorted places where it occurs. A shard is one row, so that a search reads the stored index without shuffling it;
it is a row group of its own, so that writer and reader hold one shard at once, however large the files and their splits.
``search`` takes all phrases of the test items at once: phrases of which the shard lacks a term are out, the list of the
rarest term gives each one's places, moved back by the term's offset, and the other lists, rarest first, keep those that
they hold too. Phrases don't run over the end of a document.

Words are runs of ASCII letters and digits and of any character beyond ASCII, A-Z in lower case, told by 64-bit hashes
(a phrase of n words is met wrongly only if n hashes collide at once). Test items are broadcast in passes of at most
``MAX_PHRASES`` phrases; a larger benchmark takes more passes over the one stored index, never a larger broadcast.

Defined results: null and empty texts have no words and no hits; rows that repeat a doc_id are searched one by one, one
row out for each row in; a null doc_id is kept. An item without words never occurs; repeated items count once per
item_id; an item of fewer words than the window is one phrase; items with a null item_id are left out. Other columns are
ignored, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.shared import discard, fresh, keep

#: Phrases that are broadcast at once, and places at which a task tries phrases at once.
MAX_PHRASES, MAX_PLACES = 1_000_000, 1 << 20
#: A shard is a row group: Parquet looks at sizes from the 100th row on, after some 400 MB. Its lists hold distinct numbers.
_WRITER = {"parquet.block.row.count.limit": 1, "parquet.enable.dictionary": False}
_INDEX = "shard long, terms array<long>, ends array<int>, places array<int>, ids array<long>, n_words array<int>"
_HITS = "shard long, ordinal long, doc_id long, n_words long, matches array<struct<item_id: string, item_start: int, doc_start: int, n_words: int>>"
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])
_ARROW_HITS = pa.schema([("shard", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(_MATCH))])


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = W.text_bytes(column)
    data = W.lower_table()[data]
    starts, ends, first_word = W.bounds(data, at, W.alphanumeric_table())
    return W.hashes(data, starts, ends).view(np.int64), first_word


def _items(items: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """item_ids, sorted as strings, with their terms."""
    rows = items.select(F.col("item_id").cast("string"), F.col("text")).where("item_id is not null and text is not null").distinct().toArrow()
    terms, first_word = _terms(rows.column(1))
    found = [(i, terms[a:b]) for i, a, b in zip(rows.column(0).to_pylist(), first_word[:-1], first_word[1:], strict=True) if b > a]
    found.sort(key=lambda x: x[0])
    return [i for i, _ in found], [t for _, t in found]


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of ``docs`` (doc_id, text) in the shared folder, a row for each shard.

    terms: the shard's distinct term hashes, sorted; ends: where each one's list ends in places; places: word numbers,
    counted through the shard's texts; ids and n_words: its documents, in order.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for k, batch in enumerate(W.slabs(batches, "text", 2 * W.SLAB_BYTES)):
            terms, first_word = _terms(batch.column(1))
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            heads = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
            lists = [pa.array([x], pa.list_(kind)) for x, kind in ((terms[heads], pa.int64()), (np.append(heads[1:], len(terms))[: len(heads)].astype(np.int32), pa.int32()), (order.astype(np.int32), pa.int32()))]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            n_words = pa.array([np.diff(first_word).astype(np.int32)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([partition << 24 | k]), *lists, ids, n_words], names=[x.split()[0] for x in _INDEX.split(", ")])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep(source.mapInArrow(index, _INDEX), "postings", **_WRITER)


class _Shard:
    """The lists of those terms of a shard that are in ``vocabulary`` (sorted), as keys: the term's number * 2**32 + place."""

    def __init__(self, row: dict[str, pa.Scalar], vocabulary: np.ndarray):
        terms, ends, places, n_words = (np.asarray(row[c].values) for c in ("terms", "ends", "places", "n_words"))
        self.ids = row["ids"].values
        self.n_words = n_words.astype(np.int64)
        self.first = np.append(0, np.cumsum(self.n_words))  # each document's first place, and the end
        at = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
        held = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        starts = np.append(0, ends)[at]
        self.sizes = np.where(held, np.append(ends, 0)[at] - starts, 0).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.places = places[W.ranges(starts.astype(np.int64), self.sizes)].astype(np.int64)
        self.keys = np.repeat(np.arange(len(vocabulary)), self.sizes) << 32 | self.places

    def list(self, term: int) -> np.ndarray:
        return self.places[self.ends[term] - self.sizes[term] : self.ends[term]]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


def _phrases(shard: _Shard, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which phrases (rows of term numbers, -1 after the last) begin, and the phrases' numbers."""
    sizes = np.where(phrases >= 0, shard.sizes[phrases], np.iinfo(np.int64).max)
    alive = np.flatnonzero((sizes > 0).all(axis=1))
    order = np.argsort(sizes[alive], axis=1, kind="stable")  # rarest first
    n = shard.sizes[phrases[alive, order[:, 0]]]
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // MAX_PLACES)) + 1
    found = [_begun(shard, phrases[a], lengths[a], o) for a, o in zip(np.split(alive, cuts), np.split(order, cuts), strict=True)]
    number = [a[row] for a, (_, row) in zip(np.split(alive, cuts), found, strict=True)]
    return np.concatenate([begin for begin, _ in found]), np.concatenate(number)


def _begun(shard: _Shard, phrases: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which phrases begin, and the phrases' rows. order: each one's terms, rarest first."""
    rarest = phrases[np.arange(len(phrases)), order[:, 0]]
    n = shard.sizes[rarest]
    row = np.repeat(np.arange(len(phrases)), n)
    begin = shard.places[W.ranges(shard.ends[rarest] - n, n)] - np.repeat(order[:, 0], n)
    for step in range(1, phrases.shape[1]):
        offset = order[row, step]
        term = phrases[row, offset]
        key = term << 32 | np.maximum(begin + offset, 0)
        at = np.minimum(np.searchsorted(shard.keys, key), max(0, len(shard.keys) - 1))
        stay = (term < 0) | ((shard.keys[at] == key) & (begin >= 0) if len(shard.keys) else False)
        row, begin = row[stay], begin[stay]
    inside = begin >= 0
    row, begin = row[inside], begin[inside]
    inside = shard.document(begin) == shard.document(begin + lengths[row] - 1)
    return begin[inside], row[inside]


def _near(shard: _Shard, terms: np.ndarray, span: int) -> np.ndarray:
    """Places of the rarest term round which all others occur within ``span`` words of it, in any order."""
    terms = sorted(set(terms[terms >= 0].tolist()), key=lambda t: shard.sizes[t])
    left = shard.list(terms[0])
    for term in terms[1:]:
        there = shard.list(term)
        own = shard.document(left)
        at = np.searchsorted(there, np.maximum(left - span, shard.first[own]))
        found = at < len(there)
        found[found] = there[at[found]] <= np.minimum(left + span, shard.first[own + 1] - 1)[found]
        left = left[found]
        if not len(left):
            break
    return left


def _search(names: list[str], items: list[np.ndarray], window: int, span: int | None):
    """names and items are broadcast; ``passes`` bounds them."""
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *items]))
    found = [(i, s, np.searchsorted(vocabulary, t[s : s + window])) for i, t in enumerate(items) for s in range(max(1, len(t) - window + 1))]
    of_item, of_start = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    lengths = np.array([len(f[2]) for f in found], np.int64)
    phrases = np.full((len(found), window), -1, np.int64)
    for k, f in enumerate(found):
        phrases[k, : len(f[2])] = f[2]

    def in_shard(row: dict[str, pa.Scalar]) -> pa.RecordBatch:
        shard = _Shard(row, vocabulary)
        if span is None:
            begin, number = _phrases(shard, phrases, lengths)
            length = lengths[number]
        else:
            places = [_near(shard, t, span) for t in phrases]
            number = np.repeat(np.arange(len(phrases)), [len(p) for p in places])
            begin, length = np.concatenate([np.zeros(0, np.int64), *places]), np.ones(len(number), np.int64)
        doc = shard.document(begin)
        order = np.lexsort((of_start[number], begin, of_item[number], doc))
        begin, number, length, doc = begin[order], number[order], length[order], doc[order]
        ordinal = np.arange(len(shard.ids))
        ends = np.searchsorted(doc, np.append(ordinal, len(ordinal))).astype(np.int32)
        numbers = [of_start[number], begin - shard.first[doc], length]
        fields = [pa.array([names[i] for i in of_item[number]], pa.string()), *(pa.array(x.astype(np.int32)) for x in numbers)]
        matches = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_MATCH)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ordinal), row["shard"].as_py())), pa.array(ordinal), shard.ids, pa.array(shard.n_words), matches], schema=_ARROW_HITS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield in_shard({name: batch.column(name)[i] for name in batch.schema.names})

    return search


def _covered(matches: Column) -> Column:
    """How many words lie inside one match or more."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(have: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0), span["b"] - F.greatest(span["a"], have["end"]))
        return F.struct(F.greatest(have["end"], span["b"]).alias("end"), (have["n"] + more).alias("n"))

    return F.aggregate(spans, zero, step)["n"].cast("long")


def search(index: DataFrame, items: DataFrame, window: int = 10, span: int | None = None) -> DataFrame:
    """Every indexed document with its matches: doc_id, n_words, n_hit, matches (item_id, item_start, doc_start, n_words).

    Exact phrases of ``window`` consecutive item words; with ``span``, proximity matches: all words of the phrase lie
    within ``span`` words of its rarest one, in any order, and a match is that one word. n_hit counts the words inside
    matches. Items are taken in as many passes as their size asks for.
    """
    phrases = items.select(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    n = max(1, ceil(phrases / MAX_PHRASES))
    found = []
    for k in range(n):  # one after the other: the driver holds one pass's phrases at a time
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        hits = index.mapInArrow(_search(*_items(part), window, span), _HITS)
        found.append(hits if n == 1 else keep(hits, "hits"))
    one = found[0]
    if n > 1:
        one = reduce(DataFrame.unionByName, found).groupBy("shard", "ordinal", "doc_id", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    return one.select("doc_id", "n_words", _covered(F.col("matches")).alias("n_hit"), "matches")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, span: int | None = None) -> DataFrame:
    """``search`` over a fresh index of ``docs``."""
    return search(build_index(docs), items, window, span)


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no phrase of an item, all columns as they are.

    Rows are told apart by a hash of doc_id and text, so that of rows that repeat a doc_id, or have none, those with
    a match go and the others stay.
    """
    names = fresh("number", docs.columns), fresh("digest", docs.columns)
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    rows = docs.select(row.alias("doc_id"), "text")
    index = build_index(rows)
    hit = keep(search(index, items, window).where("n_hit > 0").select("doc_id").distinct(), "contaminated").toDF(names[0])
    discard(index)
    return docs.withColumn(names[1], row).join(hit, F.col(names[1]) == F.col(names[0]), "left_anti").select(*docs.columns)
