"""Substring dedup by relative Lempel-Ziv parsing.

All documents together are the reference. It is cut into *blocks by content*: a window of ``window`` consecutive words
belongs to the block that its smallest ``SEED``-word hash names. Equal windows therefore lie in the same block, and a
document meets each block through just those of its windows that can occur there, so that parsing it against every
block costs one shuffle of its windows and no block is ever compared with unrelated text.

In a block, the index of windows gives for each one its first place: the smallest document, then the leftmost word. A
document is parsed greedily from left to right: a window found in a smaller document opens a factor, which is extended
as long as the next window continues at the next word of the same place; where it doesn't, the factor ends. Factors are
at least ``window`` words long. Every start is looked up, those inside the last factor too, so that a passage that runs
over a factor's boundary opens its own factor and nothing is lost there.

Windows that a slab of the input already holds in a smaller document are settled before the shuffle. What several
documents of a slab share is remembered for the task's next slabs (``REMEMBERED`` windows, the last used; they decide
what is sent, never what is found), so that of a passage that a third of all documents share, each task sends about one
copy. Windows are told apart by 64 bits within a block: about n^2 / (2^65 * blocks) equal hashes of unlike windows are to
be expected of n windows, one at most for 100 TB. Defined results: a null or empty text has no words; rows that
repeat a doc_id are one document to each other (they don't remove each other's words) and keep their own texts apart by
a tag, 16 bits of the text's hash, or all 64 where two texts of a doc_id would have one tag; a row with a null doc_id is neither reference nor parsed; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W

#: Words of the hashes of which the smallest names a window's block.
SEED = 6
#: Shared windows that a task remembers from slab to slab.
REMEMBERED = 1 << 19
_SENT = "block int, seeds binary, docs binary, tags binary, starts binary, counts binary, refs binary, places binary"
_SPANS = "doc_id long, tag long, start int, n_words int, ref_doc_id long, ref_start int"
_ARROW_SPANS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32())])


def _first_places(seeds: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each window the first place of an equal one, as document rank * 2**32 + start."""
    order = np.argsort(seeds)
    heads = np.flatnonzero(np.concatenate(([True], seeds[order][1:] != seeds[order][:-1])))
    place = (doc << 32) | start
    least = np.minimum.reduceat(place[order], heads)
    first = np.empty(len(seeds), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(heads, len(seeds))))
    return first


def _runs(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """Where a run begins: rows at which some column isn't the row before plus its step."""
    new = np.ones(len(columns[0][0]), bool)
    new[1:] = False
    for values, step in columns:
        new[1:] |= values[1:] != values[:-1] + step
    return np.flatnonzero(new)


def _factors(doc: np.ndarray, start: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which greedy factors begin, and their lengths in words; rows are matched windows in text order."""
    heads = _runs((doc, 0), (start, 1), (first, 1))
    return heads, np.diff(np.append(heads, len(doc))) + window - 1


def _spans(ids, tags, doc, start, first, window) -> dict[str, np.ndarray]:
    """Factors of the windows whose first place is in a smaller document."""
    found = np.flatnonzero(doc > first >> 32)
    doc, start, first = doc[found], start[found], first[found]
    if not len(doc):
        return {}
    heads, lengths = _factors(doc, start, first, window)
    return {"doc_id": ids[doc[heads]], "tag": tags[found[heads]].astype(np.int64), "start": start[heads].astype(np.int32), "n_words": lengths.astype(np.int32), "ref_doc_id": ids[first[heads] >> 32], "ref_start": (first[heads] & 0xFFFFFFFF).astype(np.int32)}


class _Shared:
    """First places of windows that several documents of a task's slabs hold, sorted by hash."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit, self.slab = limit, 0
        self.seeds = np.zeros(0, np.uint64)
        self.doc, self.start, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def among(self, seeds: np.ndarray) -> np.ndarray:
        """Rows of the remembered windows that are among ``seeds``."""
        if not len(self.seeds):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
        return np.unique(at[self.seeds[at] == seeds])

    def remember(self, seeds: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        """Put windows in, in place of older entries of theirs; those not used for longest make room."""
        self.slab += 1
        used = np.full(len(seeds), self.slab)
        seeds, at = np.unique(np.concatenate([seeds, self.seeds]), return_index=True)
        doc, start, used = (np.concatenate(x)[at] for x in ((doc, self.doc), (start, self.start), (used, self.used)))
        stay = np.sort(np.argsort(-used, kind="stable")[: self.limit])
        self.seeds, self.doc, self.start, self.used = seeds[stay], doc[stay], start[stay], used[stay]


def _send(window: int, blocks: int, slab_bytes: int, tag_type: type):
    """Texts to rows for the blocks. A row with refs holds factors found inside the slab, which the block passes on."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, pa.int32() if name == "block" else pa.binary()) for name in (x.split()[0] for x in _SENT.split(", "))])
        table = W.whitespace_table()
        shared = _Shared()
        for batch in W.slabs(batches, "text", slab_bytes):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tag = batch.column(1).to_numpy(zero_copy_only=False).astype(tag_type)
            data, at = W.text_bytes(batch.column(2))
            starts, ends, first_word = W.bounds(data, at, table)
            words = W.hashes(data, starts, ends)
            seeds = W.gram_hashes(words, window)
            block = W.mixed(W.sliding_min(W.gram_hashes(words, SEED), window - SEED + 1)) % np.uint64(blocks)
            n = np.maximum(np.diff(first_word) - window + 1, 0)  # windows of each text
            row = np.repeat(np.arange(len(ids)), n)
            if not len(row):
                continue
            at_word = W.ranges(first_word[:-1], n)
            start = at_word - first_word[:-1][row]
            seeds, block = seeds[at_word], block[at_word].astype(np.int32)
            known = shared.among(seeds)
            unique, rank = np.unique(np.concatenate([ids, shared.doc[known]]), return_inverse=True)
            rank = rank.astype(np.int64)
            doc = rank[row]
            first = _first_places(np.append(seeds, shared.seeds[known]), np.append(doc, rank[len(ids) :]), np.append(start, shared.start[known]))[: len(row)]
            again = np.flatnonzero(doc > first >> 32)
            shared.remember(seeds[again], unique[first[again] >> 32], first[again] & 0xFFFFFFFF)
            own = _spans(unique, tag[row], doc, start, first, window)
            columns: dict[str, list] = {name: [] for name in schema.names}

            def put(block, **arrays):
                columns["block"].append(block)
                for name in schema.names[1:]:
                    columns[name].append(arrays[name].tobytes() if name in arrays else None)  # noqa: B023

            if own:
                put(int(block[0]), docs=own["doc_id"], tags=own["tag"].astype(tag_type), starts=own["start"], counts=own["n_words"], refs=own["ref_doc_id"], places=own["ref_start"])
            left = np.flatnonzero(doc == first >> 32)
            left = left[np.argsort(block[left].astype(np.uint16) if blocks <= 1 << 16 else block[left], kind="stable")]
            doc, start, seeds, block, row = doc[left], start[left], seeds[left], block[left], row[left]
            pieces = _runs((block, 0), (row, 0), (start, 1))
            lengths = np.diff(np.append(pieces, len(left))).astype(np.int32)
            cuts = np.flatnonzero(np.diff(block[pieces], prepend=-1))
            for a, b in zip(cuts, np.append(cuts, len(pieces))[1:], strict=True):  # none, if all windows are settled
                low, high = pieces[a], pieces[b - 1] + lengths[b - 1]
                at_piece = pieces[a:b]
                put(int(block[low]), seeds=seeds[low:high], docs=unique[doc[at_piece]], tags=tag[row[at_piece]], starts=start[at_piece].astype(np.int32), counts=lengths[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(columns[name], schema.field(name).type) for name in schema.names], schema=schema)

    return send


def _parse(window: int, tag_type: type):
    """One block: index the windows of all pieces, then factor every piece."""

    def parse(table: pa.Table) -> pa.Table:
        def joined(name: str, kind, rows: np.ndarray) -> np.ndarray:
            values = table.column(name)
            return np.frombuffer(b"".join(values[int(i)].as_py() for i in rows), kind)

        done = np.asarray(table.column("seeds").is_null())
        passed, sent = np.flatnonzero(done), np.flatnonzero(~done)
        out = [{"doc_id": joined("docs", np.int64, passed), "tag": joined("tags", tag_type, passed).astype(np.int64), "start": joined("starts", np.int32, passed), "n_words": joined("counts", np.int32, passed), "ref_doc_id": joined("refs", np.int64, passed), "ref_start": joined("places", np.int32, passed)}]
        if len(sent):
            counts = joined("counts", np.int32, sent).astype(np.int64)
            ids, rank = np.unique(joined("docs", np.int64, sent), return_inverse=True)
            doc = np.repeat(rank.astype(np.int64), counts)
            start = W.ranges(joined("starts", np.int32, sent).astype(np.int64), counts)
            first = _first_places(joined("seeds", np.uint64, sent), doc, start)
            out.append(_spans(ids, np.repeat(joined("tags", tag_type, sent), counts), doc, start, first, window))
        return pa.table({f.name: pa.array(np.concatenate([x[f.name] for x in out if x]), f.type) for f in _ARROW_SPANS}, _ARROW_SPANS)

    return parse


def _tagged(docs: DataFrame, wide: bool) -> DataFrame:
    """doc_id, tag and text; the tag tells apart texts of rows that repeat a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(f"shiftright(xxhash64(text), {0 if wide else 48})").alias("tag"), "text")


def _needs_wide_tags(docs: DataFrame) -> bool:
    """Whether some doc_id has two texts of one short tag."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).where("doc_id is not null")
    tags = rows.groupBy("doc_id", F.shiftright("h", 48).alias("tag")).agg((F.min("h") != F.max("h")).alias("two"))
    return not tags.where("two").isEmpty()


def duplicate_spans(docs: DataFrame, window: int = 13, block_mb: float = 8, slab_mb: float = 4, wide: bool | None = None) -> DataFrame:
    """Factors that also occur in a document with a smaller doc_id.

    ``docs``: doc_id (integer), text. Returns doc_id, tag, start and n_words (counted in words; ``window`` or more), and
    the place of the factor in the reference: ref_doc_id, ref_start. Factors may overlap. ``block_mb`` bounds what one
    block holds of window hashes; the number of blocks follows the input. ``slab_mb``: text that a task looks at together.
    ``wide``: tags of 64 bits instead of 16 (None: where they are needed).
    """
    if window < SEED:
        raise ValueError(f"a window has {SEED} words or more")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(1.3 * total / (block_mb * 1e6)))
    wide = _needs_wide_tags(docs) if wide is None else wide
    tag_type = np.int64 if wide else np.int16
    sent = _tagged(docs, wide).where("doc_id is not null and text is not null").mapInArrow(_send(window, blocks, int(slab_mb * 1e6), tag_type), _SENT)
    return sent.groupBy("block").applyInArrow(_parse(window, tag_type), _SPANS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and spans (flat array of starts and lengths) to the kept text, words joined by one space."""
    table = W.whitespace_table()
    for batch in W.slabs(batches, "text"):
        data, at = W.text_bytes(batch.column(1))
        starts, ends, first_word = W.bounds(data, at, table)
        spans = batch.column(2)
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(spans), 0)).astype(np.int64)
        flat = np.asarray(spans.flatten()).reshape(-1, 2).astype(np.int64)
        base = np.repeat(first_word[:-1], size // 2)
        delta = np.zeros(len(starts) + 1, np.int64)
        np.add.at(delta, base + flat[:, 0], 1)
        np.add.at(delta, base + flat[:, 0] + flat[:, 1], -1)
        keep = np.flatnonzero(np.cumsum(delta)[:-1] == 0)
        n_words = np.diff(first_word)
        kept_before = np.searchsorted(keep, first_word)
        n_kept = np.diff(kept_before)
        length = ends[keep] - starts[keep]
        text = np.append(data, np.uint8(0x20))
        # each kept word with the space before it, then without the first space of each text
        width = length + 1
        source = W.ranges(starts[keep] - 1, width)
        place = np.concatenate(([0], np.cumsum(width)))
        source[place[:-1]] = len(data)
        heads = kept_before[:-1][n_kept > 0]
        out = np.delete(text[source], place[heads])
        ends_at = place[kept_before] - np.searchsorted(heads, kept_before)
        kept = pa.StringArray.from_buffers(len(n_kept), pa.py_buffer(ends_at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_words - n_kept), kept], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_duplicates(docs: DataFrame, window: int = 13, block_mb: float = 8, slab_mb: float = 4) -> DataFrame:
    """Every row of ``docs`` without the words of its ``duplicate_spans``: doc_id, n_words, n_removed, kept_text.

    kept_text joins the kept words by one space. A row that has lost nothing is returned too (n_removed 0).
    """
    wide = _needs_wide_tags(docs)
    spans = duplicate_spans(docs, window, block_mb, slab_mb, wide).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list(F.array("start", "n_words"))).alias("spans"))
    joined = _tagged(docs, wide).join(spans.hint("shuffle_hash"), ["doc_id", "tag"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
