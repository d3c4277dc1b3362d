"""Phrase collocations by best-first branch-and-bound growth.

Texts are cut into pieces and words; everything is counted for each language by itself. A phrase of two or more words
that occurs often enough is a candidate. Cut in two, it scores a^2 / (l * r), of its own count and those of the parts;
its lowest cut counts. A candidate that mostly occurs inside one longer candidate is dropped, and each language's best
survivors are wanted.

Growth. A phrase grows from its prefix by a word: words, then pairs, then longer phrases. The count a of a prefix p + w
bounds what can grow from it: any extension occurs at most a times, and a cut after the first word has l = f(first word)
and r of at least the extension's count, so that no extension scores more than a / f(first word). The *frontier* are the
prefixes whose bound reaches the threshold; their extensions are counted, and so are those that hold a candidate of the
threshold as their end, since they decide whether it is dropped. Then all candidates that reach the threshold are
known with their scores and fates. If a language has as many survivors as wanted, it is settled, ties at the threshold
included; for the others the threshold goes down, until they have or nothing is left to grow. The first threshold is that
of the ``FIRST`` * wanted best pairs, then ``STEP`` times as many, then none; each is read from a histogram of scores.

Counting. Each pass reads all texts. A task counts the phrases of a slab by numpy over the slab's own dictionary of words
(no hashes, so none collide) and sends each different phrase once with its count; Spark adds them up, a task at a time
before the shuffle, so that the most frequent phrase sends one row a task. Words that are too rare to be in a candidate,
and phrases that the frontier doesn't reach, are left out by a bitmap of hashes (``BITS``, the same size for any input):
it lets some others through, which are then counted in full like the rest, and never holds one back.

Scores are exact: products are decimals of 38 digits. Defined results: a null text is empty; a null language is ``und``;
documents that repeat count each time; an empty table gives no rows; other columns are ignored; texts of any length are
read whole, a slab at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.shared import discard, keep, small_batches

#: Bytes that end a piece, and those that separate words: fixed values of the contract.
BREAKS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
SCALE = 1_000_000
#: Thresholds: that of so many times the wanted number of pairs, the factor of the next round, and the last round, without any.
FIRST, STEP, ROUNDS = 4, 16, 3
#: Bits of a bitmap (4 MB).
BITS = 25
SLAB_BYTES = 1 << 20
_GRAM = "lang string, phrase string, n long"


def _bitmap(phrases: DataFrame) -> Broadcast:
    """A broadcast bitmap of the hashes of (lang, phrase); at most 2^BITS bits come to the driver, however many there are."""
    slots = phrases.select(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", "lang", "phrase")), 64 - BITS).alias("slot"))
    cells = slots.select(F.shiftright("slot", 6).alias("cell"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap has."""
    slot = (hashes >> np.uint64(65 - (8 * len(bits)).bit_length())).view(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


class _Slab:
    """Words of a slab: each one's language, number in the slab's dictionary, and piece."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        data, at = W.text_bytes(batch.column(1))
        data = W.lower_table()[data]
        inside = np.ones(256, bool)
        inside[list(BREAKS + BLANKS)] = False
        starts, ends, first = W.bounds(data, at, inside)
        ends_piece = np.zeros(256, bool)
        ends_piece[list(BREAKS)] = True
        broken = np.flatnonzero(ends_piece[data])
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.piece = np.searchsorted(broken, starts) + text  # differs between neighbours of different pieces or texts
        self.lang = np.asarray(langs.indices)[text].astype(np.int64)
        size = ends - starts
        offsets = np.concatenate(([0], np.cumsum(size)))
        packed = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[W.ranges(starts, size)].tobytes()))
        words = packed.dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def phrases(self, words: list[np.ndarray], *before: pa.Array) -> pa.Array:
        """Phrases of dictionary words as strings."""
        parts = [*before, *[self.words.take(pa.array(w)) for w in words]]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]

    def hashes(self, lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
        """XXH64 of language and phrase, as ``_bitmap`` has it."""
        data, at = W.text_bytes(self.phrases(list(words), pa.array(self.langs, pa.large_string()).take(pa.array(lang))))
        return W.xxh64(data, at[:-1], at[1:])

    def rows(self, lang: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """Language, phrase and count of phrases."""
        return pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()).take(pa.array(lang)), self.phrases(words).cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])

    def grams(self, size: int) -> np.ndarray:
        """First words of the runs of ``size`` words within a piece."""
        last = len(self.word) - size + 1
        return np.flatnonzero(self.piece[:last] == self.piece[size - 1 :]) if last > 0 else np.zeros(0, np.int64)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of small numbers, their counts, and which one each row is."""
    key, spans = columns[0], []
    for c in columns[1:]:
        spans.append(int(c.max()) + 1 if len(c) else 1)
        key = key * spans[-1] + c
    if len(key) and key.max() < 4 * len(key):
        all_counts = np.bincount(key)
        unique = np.flatnonzero(all_counts)
        counts, inverse = all_counts[unique], (np.cumsum(all_counts > 0) - 1)[key]
    else:
        unique, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    out = []
    for span in reversed(spans):
        unique, rest = np.divmod(unique, span)
        out.append(rest)
    return [unique, *reversed(out)], counts, inverse


def _counted(texts: DataFrame, count: Callable[[_Slab], pa.RecordBatch]) -> DataFrame:
    """Occurrences of phrases, by language; ``count`` gives the rows of a slab."""
    limit = SLAB_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text", limit):
            slab = _Slab(batch)
            if len(slab.word):
                yield count(slab)

    return texts.mapInArrow(run, _GRAM).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _words(slab: _Slab) -> pa.RecordBatch:
    (lang, word), n, _ = _distinct(slab.lang, slab.word)
    return slab.rows(lang, [word], n)


def _pairs(frequent: Broadcast) -> Callable[[_Slab], pa.RecordBatch]:
    """Pairs of frequent words."""

    def count(slab: _Slab) -> pa.RecordBatch:
        words, _, which = _distinct(slab.lang, slab.word)
        good = _held(frequent.value, slab.hashes(*words))[which]
        at = slab.grams(2)
        at = at[good[at] & good[at + 1]]
        (lang, a, b), n, _ = _distinct(slab.lang[at], slab.word[at], slab.word[at + 1])
        return slab.rows(lang, [a, b], n)

    return count


def _triples(frequent: Broadcast, grow: Broadcast, settle: Broadcast) -> Callable[[_Slab], pa.RecordBatch]:
    """Triples of two frequent pairs, of which the first is in the frontier or the last one a candidate to settle."""

    def count(slab: _Slab) -> pa.RecordBatch:
        at = slab.grams(2)
        pairs, _, which = _distinct(slab.lang[at], slab.word[at], slab.word[at + 1])
        hashes = slab.hashes(*pairs)
        good, wide, narrow = (np.zeros(len(slab.word), bool) for _ in range(3))
        for marks, bits in ((good, frequent), (wide, grow), (narrow, settle)):
            marks[at] = _held(bits.value, hashes)[which]
        at = slab.grams(3)
        at = at[good[at] & good[at + 1] & (wide[at] | narrow[at + 1])]
        (lang, a, b), _, head = _distinct(slab.lang[at], slab.word[at], slab.word[at + 1])
        (first, last), n, _ = _distinct(head, slab.word[at + 2])
        return slab.rows(lang[first], [a[first], b[first], last], n)

    return count


def _score(a: str, left: str, right: str) -> str:
    """SQL of floor(SCALE * a * a / (left * right)), exact up to counts of 15 digits."""
    return f"(cast({a} as decimal(15)) * cast({a} as decimal(15)) * {SCALE}bd) div (cast({left} as decimal(15)) * cast({right} as decimal(15)))"


def _with_count(rows: DataFrame, phrase: Column, counts: DataFrame, to: str) -> DataFrame:
    """``rows`` with the count of one of their parts."""
    known = counts.select("lang", F.col("phrase").alias("_part"), F.col("n").alias(to))
    return rows.withColumn("_part", phrase).join(known, ["lang", "_part"]).drop("_part")


def _part(first: int) -> Column:
    """The first words of ``phrase``, or the last ones if negative."""
    return F.substring_index("phrase", " ", first)


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs with the counts of their words, their score, and the bound of what grows from them."""
    both = _with_count(_with_count(pairs.withColumnRenamed("n", "a"), _part(1), words, "l"), _part(-1), words, "r")
    return both.withColumns({"score": F.expr(_score("a", "l", "r")), "bound": F.expr(f"(cast(a as decimal(15)) * {SCALE}bd) div cast(l as decimal(15))")})


def _scored_triples(triples: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples with the counts and the score of their lowest cut, the leftmost of equal ones."""
    pairs = pairs.select("lang", "phrase", F.col("a").alias("n"))
    out = _with_count(_with_count(triples.withColumnRenamed("n", "a"), _part(1), words, "l1"), _part(-2), pairs, "r1")
    out = _with_count(_with_count(out, _part(2), pairs, "l2"), _part(-1), words, "r2")
    out = out.withColumns({"s1": F.expr(_score("a", "l1", "r1")), "s2": F.expr(_score("a", "l2", "r2"))})
    second = F.col("s2") < F.col("s1")
    return out.select("lang", "phrase", "a", *[F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(to) for c, to in (("l", "l"), ("r", "r"), ("s", "score"))])


def _thresholds(pairs: DataFrame, rank: int) -> DataFrame:
    """For each language a score that about ``rank`` pairs reach (fewer than a thousandth of the scale apart); 0, if fewer have any."""
    step = SCALE // 1000
    steps = pairs.groupBy("lang", F.floor(F.col("score") / step).alias("step")).agg(F.count("*").alias("rows"))  # at most 1001 rows a language
    reached = steps.withColumn("rows", F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("step"))))
    return reached.groupBy("lang").agg((F.coalesce(F.max(F.when(F.col("rows") >= rank, F.col("step"))), F.lit(0)) * step).alias("threshold"))


def _best(rows: DataFrame, wanted: int) -> DataFrame:
    """The first rows of each language; a first ranking in 64 parts of each bounds what one task ranks."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = rows.withColumn("_salt", F.pmod(F.hash("phrase"), F.lit(64)))
    for keys in (("lang", "_salt"), ("lang",)):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= wanted)
    return parts.drop("_salt")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", wanted: int = 2000, least: int = 10, share: int = 50) -> DataFrame:
    """Each language's ``wanted`` best phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs ``least`` times or more; it is dropped if a longer candidate that holds it has ``share`` percent of
    its occurrences. l and r are the counts of the parts of its lowest cut, n is the number of words of the language.
    """
    with small_batches(docs.sparkSession):
        return _grown(docs, text, lang, wanted, least, share)


def _grown(docs: DataFrame, text: str, lang: str, wanted: int, least: int, share: int) -> DataFrame:
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_words = keep(_counted(texts, _words), "words")
    words = all_words.where(F.col("n") >= least)
    totals = all_words.groupBy("lang").agg(F.sum("n").alias("n"))
    counted = keep(_counted(texts, _pairs(_bitmap(words))).where(F.col("n") >= least), "pairs")
    pairs = keep(_scored_pairs(counted, words), "scored-pairs")
    discard(counted)
    frequent, settled, used = _bitmap(pairs), [], [all_words, pairs]
    thresholds = keep(_thresholds(pairs, FIRST * wanted), "thresholds")
    for round_ in range(1, ROUNDS + 1):
        here = texts.join(thresholds.select("lang"), "lang", "left_semi") if round_ > 1 else texts
        reached = pairs.join(thresholds, "lang")
        candidates = reached.where(F.col("score") >= F.col("threshold"))
        count = _triples(frequent, _bitmap(reached.where(F.col("bound") >= F.col("threshold"))), _bitmap(candidates))
        triples = keep(_counted(here, count).where(F.col("n") >= least), "triples")
        longest = triples.select("lang", F.explode(F.array(_part(2), _part(-2))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        kept = candidates.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
        grown = _scored_triples(triples, words, pairs).join(thresholds, "lang").where(F.col("score") >= F.col("threshold"))
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        best = keep(_best(kept.select(*columns).unionByName(grown.select(*columns)), wanted), "best")
        discard(triples)
        full = best.groupBy("lang").agg(F.count("*").alias("rows"))
        done = thresholds.join(full, "lang", "left").withColumn("done", (F.col("threshold") == 0) | (F.coalesce("rows", F.lit(0)) >= wanted))
        done = keep(done, "settled")
        settled.append(best.join(done.where("done").select("lang"), "lang", "left_semi"))
        rest = done.where("not done").select("lang")
        if round_ == ROUNDS or rest.isEmpty():
            break
        lower = _thresholds(pairs, wanted * FIRST * STEP**round_) if round_ < ROUNDS - 1 else pairs.select("lang").distinct().withColumn("threshold", F.lit(0))
        thresholds = keep(lower.join(rest, "lang"), "thresholds")
    found = keep(reduce(DataFrame.unionByName, settled).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*used)
    return found
